import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import access, ingest
from lodestone.plans import intake
from lodestone.plans.answer import answer_in_parts, answer_remembered, answer_single, remind, split_questions, sub_queries, summarize, summarize_together, verdicts
from lodestone.plans.model import WIDTH, Composite, HttpModel, ModelError, OfflineModel, Unavailable, build_model
from lodestone.settings import Settings
from lodestone.sources import files
from lodestone.sources.store import Store
from lodestone.sources.tables import cut
from lodestone.streaming import jobs


@pytest.fixture
def home(tmp_path):
    root = tmp_path / "in"
    (root / "sub" / ".hidden").mkdir(parents=True)
    (root / "a.txt").write_text("The apple harvest was good this year. " * 10)
    (root / "sub" / "b.MD").write_text("Cars need oil and the engine needs care. " * 10)
    (root / "sub" / ".hidden" / "secret.txt").write_text("hidden")
    (root / ".dot.txt").write_text("hidden")
    (root / "c.html").write_text("no")
    (root / "bad.pdf").write_text("not a pdf")
    with zipfile.ZipFile(root / "d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:tbl><w:tr>{cell.format('x')}{cell.format('y')}</w:tr></w:tbl><w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>")
    return root


def by_path(store):
    return {os.path.basename(r["path"]): r for r in store.table("documents").collect()}


def test_ingest_again_and_again(spark, home, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = intake.ingest_paths(store, [str(home)])
    assert {k: first[k] for k in ("added", "updated", "skipped", "removed", "blocked", "failed", "generation")} == {"added": 3, "updated": 0, "skipped": 0, "removed": 0, "blocked": 0, "failed": 1, "generation": 1}
    docs = by_path(store)
    assert set(docs) == {"a.txt", "b.MD", "d.docx", "bad.pdf"} and docs["bad.pdf"]["status"] == "error" and docs["bad.pdf"]["content_hash"] == ""
    chunks = store.table("chunks").collect()
    assert {r["text"] for r in chunks if r["doc_id"] == docs["d.docx"]["doc_id"]} == {"First\n\nLast\n\nx | y"}
    assert all(len(r["embedding"]) == WIDTH for r in chunks)

    os.utime(home / "a.txt", (1000, 1000))
    (home / "sub" / "b.MD").write_text("Bicycles need air. " * 5)
    (home / "d.docx").unlink()
    second = intake.ingest_paths(store, [str(home)])
    assert [second[k] for k in ("added", "updated", "skipped", "removed", "failed")] == [0, 1, 1, 1, 1]
    after = by_path(store)
    assert after["a.txt"]["mtime"] == 1000 and after["b.MD"]["doc_id"] == docs["b.MD"]["doc_id"] and "d.docx" not in after
    assert {r["doc_id"] for r in store.table("chunks").collect()} == {after["a.txt"]["doc_id"], after["b.MD"]["doc_id"]}

    changes = spark.createDataFrame([(str(home / "sub"), "no_access")], "path string, access_level string").selectExpr("*", "current_timestamp()::timestamp_ntz AS changed_at")
    intake.set_access(store, changes)
    assert set(by_path(store)) == {"a.txt", "bad.pdf"}
    third = intake.ingest_paths(store, [str(home)])
    assert third["blocked"] == 1 and third["added"] == 0

    assert {r["doc_id"] for r in store.table("postings").collect()} == {r["doc_id"] for r in store.table("chunks").collect()}
    asked = spark.createDataFrame([(1, "apple harvest"), (2, "zzzz")], "qid long, question string")
    got = {r["qid"]: r for r in answer_single(asked, store.table("chunks"), store.table("documents"), vectors=store.table("chunks").select("chunk_id", "embedding")).collect()}
    assert got[1]["answer"].startswith("See [1]") and got[1]["sources"][0]["filename"] == "a.txt"

    with pytest.raises(PermissionError):
        intake.set_access(store, spark.createDataFrame([(str(home), "readonly")], "path string, access_level string").selectExpr("*", "current_timestamp()::timestamp_ntz AS changed_at"))
        intake.delete_document(store, by_path(store)["a.txt"]["doc_id"])
    with pytest.raises(ValueError):
        intake.ingest_paths(store, [str(home)], model=Composite(OfflineModel(), OfflineModel()))
    with pytest.raises(FileNotFoundError):
        intake.ingest_paths(store, [str(home / "none")])
    with pytest.raises(PermissionError):
        intake.ingest_paths(store, [str(home)], force=True)
    seen = []
    (home / "new.txt").write_text("New text about pears.")
    query = jobs.watch(store, [str(home)], on_change=seen.append, once=True)
    query.awaitTermination(120)
    assert len(seen) == 1 and seen[0]["added"] == 1


def test_only_changed_files_are_opened_and_only_touched_buckets_written(spark, tmp_path):
    root = tmp_path / "many"
    root.mkdir()
    for i in range(30):
        (root / f"{i}.txt").write_text(f"Text number {i} about gardens.")
    store, opened = Store(spark, str(tmp_path / "store")), spark.sparkContext.accumulator(0)
    assert intake.ingest_paths(store, [str(root)], opened=opened)["added"] == 30 and opened.value == 30
    before = store._state()["tables"]
    (root / "7.txt").write_text("Text number seven, edited.")
    (root / "blank.txt").write_text("  ")
    got = intake.ingest_paths(store, [str(root)], opened=opened)
    assert got["updated"] == 1 and got["failed"] == 1 and got["skipped"] == 29 and opened.value == 32
    after = store._state()["tables"]
    for name in ("chunks", "postings"):
        assert len([b for b, p in after[name].items() if before[name].get(b) != p]) <= 2 < len(after[name])
    assert store.table("chunks").count() == 30 and store.table("chunks").select("chunk_id").distinct().count() == 30
    (root / ".8.txt").write_text("hidden")
    (root / "9.txt").unlink()
    assert intake.ingest_paths(store, [str(root)])["removed"] == 1
    assert store.vacuum(keep=1) and store.table("chunks").count() == 29 and store.generations() == [3]


@pytest.mark.parametrize("step", ["first table", "pointer"])
def test_a_commit_that_dies_leaves_the_last_generation(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path / "s"))
    row = lambda n: spark.createDataFrame([(n, "a", "b", "c", 0.5, None)], "fact_id long, subject string, predicate string, object string, confidence double, source string")
    store.commit({"facts": row(1)})

    class Dies(Exception):
        pass

    def die(*_):
        raise Dies

    with monkeypatch.context() as m:
        if step == "pointer":
            real = store._fs
            m.setattr(store, "_fs", type("Fs", (), {"rename": die, "__getattr__": lambda self, name: getattr(real, name)})())
        else:
            own = Store._write
            m.setattr(Store, "_write", lambda self, name, df, number: die() if name == "entities" else own(self, name, df, number))
        with pytest.raises(Dies):
            store.commit({"facts": row(2), "entities": store.table("entities")})
    again = Store(spark, str(tmp_path / "s"))
    assert again.generation == 1 and [r["fact_id"] for r in again.table("facts").collect()] == [1]
    assert again.commit({"facts": row(3)}) == 2 and [r["fact_id"] for r in Store(spark, str(tmp_path / "s")).table("facts").collect()] == [3]


def test_ids_of_many_new_documents_are_distinct(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        known = spark.range(1000).selectExpr("id AS doc_id", "concat('/k/', id) AS path", "'h' AS content_hash")
        fresh = spark.range(200_000).selectExpr("0L AS doc_id", "concat('/n/', sha2(cast(id AS string), 256)) AS path", "'h' AS content_hash").unionByName(known.where("doc_id < 10"))
        merged = ingest.merge_documents(known, fresh)
        row = merged.selectExpr("count(*) AS n", "count(DISTINCT doc_id) AS ids", "max(doc_id) AS top").first()
        assert (row["n"], row["ids"], row["top"]) == (201_000, 201_000, 200_999)
        paths = merged.where("doc_id > 999").orderBy("doc_id").select("path")
        assert paths.selectExpr("path", "lead(path) OVER (ORDER BY path) AS after").where("after < path").count() == 0
        assert merged.where("path = '/k/5' AND doc_id = 5").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_more_reminders_than_a_list_are_all_fired(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"reminders": spark.range(25).selectExpr("id AS reminder_id", "'t' AS title", "TIMESTAMP_NTZ'2020-01-01 00:00:00' AS due_at", "TIMESTAMP_NTZ'2020-01-01 00:00:00' AS created_at", "'pending' AS status", "cast(null AS string) AS source_text")})
    fired = []
    jobs.notify(store, fired.append, once=True, most=10).awaitTermination(120)
    assert [len(f) for f in fired] == [10, 10, 5] and store.table("reminders").where("status = 'notified'").count() == 25


def test_reminders_are_fired_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.sql("SELECT * FROM VALUES (1L, 'a', TIMESTAMP_NTZ'2020-01-01 00:00:00', TIMESTAMP_NTZ'2020-01-01 00:00:00', 'pending', CAST(NULL AS STRING)), (2L, 'b', TIMESTAMP_NTZ'2999-01-01 00:00:00', TIMESTAMP_NTZ'2020-01-01 00:00:00', 'pending', 'x') AS t(reminder_id, title, due_at, created_at, status, source_text)")
    store.commit({"reminders": rows})
    fired = []
    for _ in range(2):
        jobs.notify(store, fired.extend, once=True).awaitTermination(120)
    assert [r["reminder_id"] for r in fired] == [1] and {r["status"] for r in store.table("reminders").collect()} == {"notified", "pending"}


def test_store_keeps_the_last_generation(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.generation == 0 and store.table("facts").count() == 0
    store.commit({"facts": spark.createDataFrame([(1, "a", "b", "c", 0.5, None)], "fact_id long, subject string, predicate string, object string, confidence double, source string")}, {"k": 1})
    assert store.generation == 1 and store.table("facts").count() == 1 and store.meta("k") == 1
    store.truncate("facts")
    assert store.generation == 2 and store.table("facts").count() == 0 and store.meta("k") == 1


def test_levels_of_nested_and_odd_folders(spark):
    rules = spark.createDataFrame([("/v", "edit"), ("/v/a_b", "no_access"), ("/v/a_b/x/", "readonly"), ("/", "readonly"), (None, "edit")], "path string, access_level string")
    rows = spark.createDataFrame([("/v/a_b/f",), ("/v/a%b/f",), ("/v/azb/f",), ("/v/a_b/x/y/f",), ("/v/a_b",), ("/w",), (None,), ("/v/a_b",)], "path string").selectExpr("*", "1 AS _level0")
    got = {(r["path"], r["access_level"]) for r in access.resolve(rows, rules).collect()}
    assert got == {("/v/a_b/f", "no_access"), ("/v/a%b/f", "edit"), ("/v/azb/f", "edit"), ("/v/a_b/x/y/f", "readonly"), ("/v/a_b", "no_access"), ("/w", "readonly"), (None, "edit")}
    assert access.resolve(rows, rules.limit(0)).where("access_level <> 'edit'").count() == 0
    assert access.purge(rows.where("path is not null"), rules.where("path = '/v/a_b'")).count() == 3
    with pytest.raises(ValueError):
        access.set_levels(rules.selectExpr("1L AS folder_id", "*"), spark.createDataFrame([("/x", "all")], "path string, access_level string").selectExpr("*", "1 AS changed_at"))


def test_classification(spark):
    known = spark.createDataFrame([("/a", 1.0, 1, "h", "ok"), ("/b", 1.0, 1, "h", "ok"), ("/c", 1.0, 1, "h", "ok"), ("/e", 1.0, 1, "", "error")], "path string, mtime double, size long, content_hash string, status string")
    listing = spark.createDataFrame([("/a", 1.0, 1, "h"), ("/b", 2.0, 1, "h"), ("/c", 2.0, 1, "i"), ("/d", 1.0, 1, "h"), ("/e", 1.0, 1, "h")], "path string, mtime double, size long, content_hash string")
    act = lambda **k: {r["path"]: r["action"] for r in ingest.classify(listing, known, **k).collect()}
    assert act() == {"/a": "unchanged", "/b": "touched", "/c": "updated", "/d": "added", "/e": "updated"}
    assert set(act(force=True).values()) == {"updated", "added"}


def test_models(spark):
    assert isinstance(build_model("offline", "none"), Composite)
    with pytest.raises(ValueError):
        build_model("x")
    with pytest.raises(ModelError):
        Unavailable().chat("", "")
    asked = spark.createDataFrame([(1, "compare the rent of both flats and list all the open payments of march"), (2, "rent")], "qid long, question string")
    parts = split_questions(asked, OfflineModel(), Settings())
    assert {(r["qid"], r["sub"]) for r in parts.collect()} == {(1, 1), (1, 2), (2, 1)}
    assert split_questions(asked, Unavailable(), Settings()).where("search_query = question").count() == 2
    said = spark.createDataFrame([(1, '{"sub_queries": [{"question": " ", "search_query": "x"}, {"question": "q", "search_query": "s", "key_terms": ["a", " ", "b"]}]}'), (2, "no json")], "qid long, answer string")
    assert {(r["qid"], r["search_query"], tuple(r["key_terms"])) for r in sub_queries(asked, said).collect()} == {(1, "s", ("a", "b")), (2, "rent", ())}
    checked = spark.createDataFrame([(1, '{"confidence": 7, "gaps": ["a", " ", "b"]}'), (2, None)], "qid long, answer string")
    assert [tuple(r)[1:] for r in verdicts(checked).orderBy("qid").collect()] == [(1.0, True, ["a", "b"]), (None, None, None)]


def test_answers_in_parts(spark):
    chunks = spark.createDataFrame([(i, i % 3, i, f"{w} text number {i} " * 5, 0, 10, None) for i, w in enumerate(["rent", "payments", "flats", "garden", "rent", "march"])], "chunk_id long, doc_id long, chunk_idx int, text string, char_start int, char_end int, page int")
    docs = spark.createDataFrame([(i, f"f{i}.txt", f"/f{i}.txt") for i in range(3)], "doc_id long, filename string, path string")
    facts = spark.createDataFrame([(5, "payments", "are", "late", 0.9)], "fact_id long, subject string, predicate string, object string, confidence double")
    asked = spark.createDataFrame([(1, "compare the rent of both flats and list all the open payments of march"), (2, "garden"), (3, None)], "qid long, question string")
    got = {r["qid"]: r for r in answer_in_parts(asked.where("qid < 3"), chunks, docs, facts=facts).collect()}
    assert got[1]["pipeline"] == "full" and got[1]["confidence"] is not None and got[1]["sources"] and got[2]["pipeline"] == "fast" and got[2]["checked"] is None
    failing = {r["qid"]: r["answer"] for r in answer_in_parts(asked.where("qid = 1"), chunks, docs, model=Composite(Unavailable(), OfflineModel())).collect()}
    assert failing == {1: "NOT_FOUND"}


def test_answers_are_remembered(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    chunks = spark.createDataFrame([(1, 1, 0, "The rent is due in March.", None), (2, 1, 1, "The garden is green.", None)], "chunk_id long, doc_id long, chunk_idx int, text string, page int")
    docs = spark.createDataFrame([(1, "f.txt", "/f.txt")], "doc_id long, filename string, path string")
    asked = spark.createDataFrame([(1, "when is the rent due"), (2, "when is the rent due"), (3, "zzzz")], "qid long, question string")
    items = spark.createDataFrame([(7, "the rent is high", 0.9)], "item_id long, text string, importance double")
    turns, cache, got = store.table("conversation_turns"), store.table("answers"), []
    for time, generation in (("2024-03-01 10:00:00", 1), ("2024-03-01 10:30:00", 1), ("2024-03-01 10:40:00", 2), ("2024-03-01 12:00:00", 2)):
        made, turns, cache = answer_remembered(asked, chunks, docs, turns, items, cache, F.lit(time).cast("timestamp_ntz"), generation)
        got.append({r["qid"]: (r["answer"], r["pipeline"], len(r["sources"] or [])) for r in made.collect()})
        turns, cache = cut(turns), cut(cache)
    assert got[0][1][:2] == ("See [1] and [2].", "fast") and {x[1] for x in got[0].values()} == {"fast"}
    assert {x[1] for x in got[1].values()} == {"cached"} and [x[0] for x in got[1].values()] == [got[0][q][0] for q in got[1]]
    assert {x[1] for x in got[2].values()} == {"fast"} and {x[1] for x in got[3].values()} == {"fast"}  # another generation; expired
    assert turns.count() == 3 * 6 and cache.count() == 2 and turns.where("role = 'user'").count() == 9
    assert [r[0] for r in turns.orderBy("turn_id").select("turn_id").collect()] == list(range(1, 19))


def test_reminders_by_a_model(spark):
    class Splitter(OfflineModel):  # within the test, so that tasks get it whole
        def chat_json(self, system, user, schema=None):
            return {"title": "water plants", "when_phrase": "tomorrow at noon"} if "plants" in user else {"title": "x", "when_phrase": None}

    rows = spark.createDataFrame([(1, "remind me to pay rent tomorrow"), (2, "plants want water soonish"), (3, "some day"), (4, None)], "qid long, text string").withColumn("now", F.lit("2024-03-20 12:34:56").cast("timestamp_ntz"))
    got = {r["qid"]: (r["title"], str(r["due_at"]), r["error"]) for r in remind(rows, Splitter()).collect()}
    assert got[1] == ("pay rent", "2024-03-21 09:00:00", None) and got[2] == ("water plants", "2024-03-21 12:00:00", None)
    assert got[3][:2] == (None, "None") and got[3][2] and got[4][2]
    assert remind(rows, Unavailable()).where("error is null").count() == 1 and remind(rows).where("error is null").count() == 1


def test_due_stream_gives_each_reminder_once(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-01 00:00:00', TIMESTAMP'2024-01-02 00:00:00'), (1L, TIMESTAMP'2024-01-01 00:00:00', TIMESTAMP'2024-01-02 00:01:00'), (2L, TIMESTAMP'2025-01-01 00:00:00', TIMESTAMP'2024-01-02 00:00:00') AS t(reminder_id, due_at, now)")
    rows.write.parquet(str(tmp_path / "events"))
    stream = jobs.due_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.format("memory").queryName("due_once").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r["reminder_id"] for r in spark.table("due_once").collect()] == [1]


def test_a_server_model_asks_again_and_counts(monkeypatch):
    model, said = HttpModel("http://x/", "chat", "embed"), iter(["no json", '{"a": 1}', "[1]", "none"])
    monkeypatch.setattr(HttpModel, "_send", lambda self, route, body=None: {"choices": [{"message": {"content": next(said)}}]} if "chat" in route else {"data": [{"id": "chat:latest"}]} if route == "/models" else {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert model.chat_json("s", "u", {"type": "object"}) == {"a": 1}
    with pytest.raises(ModelError):
        model.chat_json("s", "u")
    assert model.embed(["a", "b"]) == [[1.0], [2.0]] and model.is_up() and model.missing_models() == ["embed"]
    with pytest.raises(ModelError):
        model.embed(["a"])


def test_summaries(spark):
    docs = spark.createDataFrame([(1, "a", "Short text. " * 3), (2, "b", None), (3, "c", "Long sentence here. " * 400)], "doc_id long, filename string, text string")
    got = {r["doc_id"]: r["summary"] for r in summarize(docs, limit_tokens=100).collect()}
    assert got[2] is None and got[1].startswith("SUMMARISE") and got[3].startswith("Partial")
    assert summarize_together(docs.where("doc_id <> 2")).count() == 1
    with pytest.raises(ValueError):
        summarize(docs, "haiku")
    with pytest.raises(ValueError):
        summarize_together(docs.limit(0))


def test_extraction_never_throws():
    assert files.extract_one("x.txt", b"ok \xff")[0] == "ok �"
    for name, data in (("x.docx", b"zip?"), ("x.pdf", b""), ("x.exe", b""), ("x.txt", None), (None, b"")):
        text, pages, error = files.extract_one(name, data)
        assert text is None and pages == [] and error
