import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import details, memory, reminders


def test_cache_evicts_the_least_recent():
    c = memory.ResultCache(2, 10)
    c.put("a", 1, 0)
    c.put("b", 2, 0)
    assert c.get("a", 1) == 1
    c.put("c", 3, 1)
    assert c.get("b", 2) is None and c.get("a", 10) == 1 and c.get("a", 10.5) is None
    c.put("g", 1, 0, generation=1)
    assert c.get("g", 1, generation=2) is None and c.stats()["misses"] == 3


def test_replay_equals_the_live_cache(spark):
    rng = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), f"k{rng.randint(0, 9)}", base + dt.timedelta(seconds=rng.randint(0, 5000)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "shard string, key string, ts timestamp_ntz, seq long")
    got = {r["shard"]: (r["hits"], r["misses"]) for r in memory.replay_lru(df, 4, 300).collect()}
    for shard in "ab":
        c = memory.ResultCache(4, 300)
        for s, k, t, _ in sorted(rows, key=lambda r: (r[2], r[3])):
            if s == shard and c.get(k, t.timestamp()) is None:
                c.put(k, 1, t.timestamp())
        assert got[shard] == (c.hits, c.misses)
    hits = {r["seq"]: r["hit"] for r in memory.replay_ttl(df, 300, ("shard", "key")).collect()}
    live = {}
    for s, k, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        hit = (s, k) in live and live[s, k] >= t
        if not hit:
            live[s, k] = t + dt.timedelta(seconds=300)
        assert hits[i] == hit
    assert memory.replay_lru(df.limit(0)).count() == 0


def test_facts(spark):
    rows = [(1, "Anna", "knows", "Bo", 0.4, None), (2, "anna", "KNOWS", "bo", 2.0, "s"), (3, "ANNA", "knows", "Bo", None, None), (4, " ", "x", "y", 1.0, None), (5, "Bo", "knows", "Cy", 0.2, None), (6, "É", "is", "é", 0.1, None), (7, None, "a", "b", 1.0, "z")]
    merged = memory.merge_facts(spark.createDataFrame(rows, "seq long, subject string, predicate string, object string, confidence double, source string"))
    got = {(r["subject"], r["confidence"], r["source"], r["created_seq"]) for r in merged.collect()}
    assert got == {("Anna", 1.0, "s", 1), ("Bo", 0.2, None, 5), ("É", 0.1, None, 6)}
    facts = merged.withColumn("fact_id", F.col("created_seq"))
    starts = spark.createDataFrame([("ANNA",), ("cy",), ("nobody",), (" ",), (None,)], "start string")
    for depth, want in ((0, set()), (1, {("ANNA", 1), ("cy", 5)}), (2, {("ANNA", 1), ("ANNA", 5), ("cy", 5), ("cy", 1)})):
        assert {(r["start"], r["fact_id"]) for r in memory.related(facts, starts, depth).collect()} == want
    assert [r["fact_id"] for r in memory.query_facts(facts, predicate="Knows").collect()] == [1, 5]
    assert memory.fact_stats(facts.limit(0)).first().asDict() == {"facts": 0, "mean_confidence": 0.0}


def test_entities_and_items(spark):
    rows = [(1, "Bo", "person", None), (2, "BO", None, "tall"), (3, "bo", "dog", None), (4, None, "x", "y")]
    r = memory.merge_entities(spark.createDataFrame(rows, "seq long, name string, entity_type string, description string")).collect()
    assert [tuple(x) for x in r] == [("bo", "Bo", "dog", "tall", 1, 3)]
    items = spark.createDataFrame([(1, "red car", 0.9, None), (2, "blue car", 5.0, None), (3, None, None, None), (4, "green", 0.1, None)], "item_id long, text string, importance double, created_at timestamp_ntz")
    top = memory.most_important(items, 3)
    assert [x["item_id"] for x in top.collect()] == [2, 1, 3]
    asked = spark.createDataFrame([(1, "a red car"), (2, None)], "qid long, question string")
    assert [(x["qid"], x["item_id"]) for x in memory.search(top, asked, 2).orderBy("qid", "place").collect()] == [(1, 1), (1, 2), (2, 2), (2, 1)]


NOW = dt.datetime(2026, 7, 14, 10, 0)  # a Tuesday


@pytest.mark.parametrize(
    "text,title,due",
    [
        ("remind me to call the bank tomorrow", "call the bank", dt.datetime(2026, 7, 15, 9)),
        ("Remind me about the review on Friday at 3pm", "the review", dt.datetime(2026, 7, 17, 15)),
        ("stretch in 2 hours", "stretch", dt.datetime(2026, 7, 14, 12)),
        ("please remind me to pay rent on 2026-08-01", "pay rent", dt.datetime(2026, 8, 1, 9)),
        ("submit the form next Friday", "submit the form", dt.datetime(2026, 7, 17, 9)),
        ("water plants tomorrow at 07:30", "water plants", dt.datetime(2026, 7, 15, 7, 30)),
        ("lunch today at noon", "lunch", dt.datetime(2026, 7, 14, 12)),
        ("ring mum at 9am", "ring mum", dt.datetime(2026, 7, 15, 9)),
        ("buy milk in a week", "buy milk", dt.datetime(2026, 7, 21, 9)),
        ("no date here", None, None),
        ("tomorrow", None, None),
        (None, None, None),
    ],
)
def test_reminder_phrases(spark, text, title, due):
    row = reminders.parse(spark.createDataFrame([(text, NOW)], "text string, now timestamp_ntz")).first()
    assert (row["title"], row["due_at"]) == (title, due) and (row["error"] is None) == (due is not None)


def test_reminder_rows(spark):
    rows = [(i, "t", NOW + dt.timedelta(days=d), NOW, s, None) for i, d, s in ((1, -1, "pending"), (2, 1, "pending"), (3, -2, "done"), (4, 0, "pending"))]
    df = spark.createDataFrame(rows, "reminder_id long, title string, due_at timestamp_ntz, created_at timestamp_ntz, status string, source_text string")
    assert [r["reminder_id"] for r in reminders.due(df, F.lit(NOW).cast("timestamp_ntz")).collect()] == [1, 4]
    assert [r["reminder_id"] for r in reminders.open_reminders(df).collect()] == [1, 4, 2]
    change = lambda i, s: reminders.set_status(df, spark.createDataFrame([(i, s)], "reminder_id long, status string"))
    assert {r["reminder_id"]: r["status"] for r in change(2, "done").collect()}[2] == "done"
    with pytest.raises(ValueError):
        change(1, "lost")
    with pytest.raises(KeyError):
        change(99, "done")
    parsed = reminders.parse(spark.createDataFrame([("call tomorrow", NOW), ("no date", NOW)], "text string, now timestamp_ntz"))
    assert [(r["reminder_id"], r["status"]) for r in reminders.add(df, parsed).where("reminder_id > 4").collect()] == [(5, "pending")]


def test_pattern_scan(spark):
    df = spark.createDataFrame([(1, "mail a.b@x.org or +49 30 123 4567, iban DE44500105175407324931, 123-45-6789"), (2, None), (3, "")], "chunk_id long, text string")
    got = {(r["kind"], r["text"]) for r in details.scan(df).collect()}
    assert {("email", "a.b@x.org"), ("iban", "DE44500105175407324931"), ("phone", "123-45-6789")} <= got


def test_model_findings(spark):
    texts = spark.createDataFrame([(1, "aXa aXaXa"), (2, None)], "chunk_id long, text string")
    said = spark.createDataFrame([(1, '{"items": [{"text": " aXa ", "kind": "name"}, {"text": "gone"}, {"text": ""}]}'), (2, '{"items": [{"text": "x"}]}'), (1, "broken")], "chunk_id long, answer string")
    assert sorted(tuple(r)[1:4] for r in details.model_spans(texts, said).collect()) == [(0, 3, "aXa"), (4, 7, "aXa"), (6, 9, "aXa")]
    acts = spark.createDataFrame([(1, '{"items": [{"task": " do ", "owner": "", "due_date": "soon", "source_snippet": " s "}, {"task": " "}]}'), (2, None)], "qid long, answer string")
    assert [tuple(r) for r in details.actions(acts).collect()] == [(1, 0, "do", None, "soon", "s")]
