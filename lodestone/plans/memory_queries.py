"""Queries of memory, the fact graph, the result cache and reminders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import context, memory, reminders
from lodestone.plans.search_queries import _facts, QS, fact_rows, facts, questions
from lodestone.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {_facts} SELECT subject, predicate, object, confidence, source, created_seq FROM fm")
def fact_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return memory.merge_facts(fact_rows(spark, folder)).select("subject", "predicate", "object", "confidence", "source", "created_seq")


@query(
    """WITH e AS (SELECT c_custkey * 3 AS seq, c_name AS name, c_mktsegment AS entity_type, NULL AS description FROM customer
 UNION ALL SELECT c_custkey * 3 + 1, lower(c_name), NULL, 'a customer' FROM customer UNION ALL SELECT c_custkey * 3 + 2, upper(c_name), CASE WHEN c_custkey % 2 = 0 THEN 'even' END, NULL FROM customer)
 SELECT arg_min(name, seq) AS name, arg_max(entity_type, seq) FILTER (entity_type IS NOT NULL) AS entity_type, arg_max(description, seq) FILTER (description IS NOT NULL) AS description, min(seq) AS created_seq, max(seq) AS updated_seq FROM e GROUP BY lower(name)"""
)
def entity_upsert(spark: SparkSession, folder: str) -> DataFrame:
    c, key, none = table(spark, folder, "customer"), F.col("c_custkey") * 3, F.lit(None).cast("string")
    one = c.select(key.alias("seq"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"), none.alias("description"))
    two = c.select((key + 1).alias("seq"), F.lower("c_name").alias("name"), none.alias("entity_type"), F.lit("a customer").alias("description"))
    three = c.select((key + 2).alias("seq"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "even").alias("entity_type"), none.alias("description"))
    return memory.merge_entities(one.unionByName(two).unionByName(three)).drop("name_key")


@query(
    f"""WITH {_facts}, e AS (SELECT created_seq AS fact_id, confidence, subject_key AS a, object_key AS b FROM fm UNION ALL SELECT created_seq, confidence, object_key, subject_key FROM fm),
 s AS (SELECT DISTINCT lower(r_name) AS start FROM region), h0 AS (SELECT start, fact_id, confidence, b FROM s JOIN e ON start = a), n1 AS (SELECT DISTINCT start, b AS name FROM h0 WHERE b <> start),
 h1 AS (SELECT start, fact_id, confidence FROM n1 JOIN e ON name = a), h AS (SELECT DISTINCT * FROM (SELECT start, fact_id, confidence FROM h0 UNION ALL SELECT * FROM h1))
 SELECT * FROM (SELECT start, fact_id, confidence, row_number() OVER (PARTITION BY start ORDER BY confidence DESC, fact_id) AS rank FROM h) WHERE rank <= 50"""
)
def kb_related(spark: SparkSession, folder: str) -> DataFrame:
    starts = table(spark, folder, "region").select(F.lower("r_name").alias("start"))
    return memory.related(facts(spark, folder), starts, depth=2)


@query(f"WITH {_facts} SELECT created_seq AS fact_id, subject, object, confidence FROM fm WHERE lower(predicate) = 'located in' AND confidence >= 0.5")
def kb_query(spark: SparkSession, folder: str) -> DataFrame:
    return memory.query_facts(facts(spark, folder), predicate="Located IN", least=0.5).select("fact_id", "subject", "object", "confidence")


@query(f"WITH {_facts} SELECT count(*) AS facts, coalesce(round(avg(confidence), 6), 0.0) AS mean_confidence FROM fm")
def kb_stats(spark: SparkSession, folder: str) -> DataFrame:
    return memory.fact_stats(facts(spark, folder))


TURNS = "turns AS (SELECT DISTINCT ON (turn_id) turn_id, role, content, created_at FROM conversation_turns WHERE role IN ('user', 'assistant'))"


@query(f"WITH {TURNS} SELECT turn_id, role, content, created_at FROM turns ORDER BY turn_id DESC LIMIT 10")
def recent_turns(spark: SparkSession, folder: str) -> DataFrame:
    return memory.newest(table(spark, folder, "conversation_turns")).select("turn_id", "role", "content", "created_at")


@query(f"WITH {TURNS} SELECT * FROM (SELECT turn_id, role, strftime(created_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY created_at::DATE ORDER BY turn_id DESC) AS n FROM turns) WHERE n <= 10".replace("SELECT * FROM (SELECT turn_id", "SELECT turn_id, role, day FROM (SELECT turn_id"))
def memory_prune_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The newest ten turns of each day, as if a day were a conversation."""
    turns = table(spark, folder, "conversation_turns").withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return memory.newest(turns, by="day").select("turn_id", "role", "day")


_items = f"""{TURNS}, items AS (SELECT turn_id AS item_id, content AS text, (turn_id % 11) / 10.0::DOUBLE AS importance, created_at FROM turns WHERE content IS NOT NULL
 ORDER BY importance DESC, created_at DESC NULLS LAST, item_id DESC LIMIT 100)"""


def _items_of(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversation_turns").where("role in ('user', 'assistant') and content is not null").dropDuplicates(["turn_id"])
    return memory.most_important(turns.select(F.col("turn_id").alias("item_id"), F.col("content").alias("text"), ((F.col("turn_id") % 11) / 10.0).alias("importance"), "created_at"))


@query(f"WITH {_items} SELECT item_id, importance FROM items")
def memory_prune_items(spark: SparkSession, folder: str) -> DataFrame:
    return _items_of(spark, folder).select("item_id", "importance")


_tok = r"list_distinct(list_filter(regexp_extract_all(lower(%s), '[\p{L}\p{N}_]+'), lambda t: length(t) > 1))"
_search = f"""{_items}, {QS}, sr AS (SELECT qid, item_id, text, len(list_intersect({_tok % "question"}, {_tok % "text"}))::BIGINT AS overlap, importance FROM qs, items),
 found AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, importance DESC, item_id) AS place, item_id, overlap, text FROM sr) WHERE place <= 5)"""


@query(f"WITH {_search} SELECT qid, place, item_id, overlap FROM found")
def memory_search(spark: SparkSession, folder: str) -> DataFrame:
    return memory.search(_items_of(spark, folder), questions(spark, folder))


@query(
    f"""WITH {_search}, rc AS (SELECT turn_id, role || ': ' || coalesce(content, '') AS line FROM turns ORDER BY turn_id DESC LIMIT 10),
 sp AS (SELECT *, sum(greatest(1, length(line) // 4)) OVER (ORDER BY turn_id DESC) AS spent, row_number() OVER (ORDER BY turn_id DESC) AS n FROM rc),
 said AS (SELECT max(spent) AS used, string_agg(line, chr(10) ORDER BY turn_id) AS said FROM sp WHERE spent <= 280 OR n = 1),
 kl AS (SELECT qid, place, 'known: ' || text AS line, 400 - used AS room FROM found, said),
 ks AS (SELECT *, sum(greatest(1, length(line) // 4)) OVER (PARTITION BY qid ORDER BY place) AS spent FROM kl WHERE room > 0),
 kn AS (SELECT qid, string_agg(line, chr(10) ORDER BY place) AS known FROM ks WHERE spent <= room OR place = 1 GROUP BY qid)
 SELECT qid, 'Recent conversation:' || chr(10) || said || CASE WHEN known IS NULL THEN '' ELSE chr(10) || chr(10) || 'Remembered facts:' || chr(10) || known END AS context FROM qs LEFT JOIN kn USING (qid), said"""
)
def memory_context(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    items = _items_of(spark, folder)
    recent = memory.newest(table(spark, folder, "conversation_turns")).select(F.lit(1).alias("_one"), F.col("turn_id").alias("seq"), "role", "content")
    turns = asked.select("qid", F.lit(1).alias("_one")).join(F.broadcast(recent), "_one").drop("_one")  # ten rows
    known = memory.search(items, asked).join(F.broadcast(items.select("item_id", "text")), "item_id")  # a hundred rows
    return context.bounded_memory(turns, known, asked)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
 r AS (SELECT user_id, event_type, ts, event_id, n, false AS hit, ts + INTERVAL 12 HOUR AS expires FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_type, e.ts, e.event_id, e.n, r.expires >= e.ts, CASE WHEN r.expires >= e.ts THEN r.expires ELSE e.ts + INTERVAL 12 HOUR END FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1)
 SELECT event_id, hit FROM r"""
)
def cache_ttl_replay(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where("ts is not null").withColumn("seq", F.col("event_id"))
    return memory.replay_ttl(events, 12 * 3600, ("user_id", "event_type")).select(F.col("seq").alias("event_id"), "hit")


@query()
def cache_lru_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of 20 entries for each kind of event."""
    rows = table(spark, folder, "events").where("ts is not null").select(F.col("event_type").alias("shard"), F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"))
    return memory.replay_lru(rows, max_size=20, ttl_s=86_400.0)


@query("SELECT reminder_id, title, due_at FROM reminders WHERE status <> 'done'")
def reminders_open(spark: SparkSession, folder: str) -> DataFrame:
    return reminders.open_reminders(table(spark, folder, "reminders")).select("reminder_id", "title", "due_at")


@query("SELECT reminder_id, due_at FROM reminders WHERE status = 'pending' AND due_at <= TIMESTAMP '2024-03-20 12:00:00'")
def reminders_due(spark: SparkSession, folder: str) -> DataFrame:
    return reminders.due(table(spark, folder, "reminders"), F.lit("2024-03-20 12:00:00").cast("timestamp_ntz")).select("reminder_id", "due_at")


@query("SELECT reminder_id, CASE WHEN status = 'pending' AND due_at <= TIMESTAMP '2024-03-20 12:00:00' THEN 'notified' ELSE status END AS status FROM reminders")
def reminders_notified(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "reminders")
    due = reminders.due(own, F.lit("2024-03-20 12:00:00").cast("timestamp_ntz"))
    return reminders.set_status(own, due.select("reminder_id", F.lit("notified").alias("status"))).select("reminder_id", "status")


@query("SELECT reminder_id, CASE WHEN hour(due_at) = hour(created_at) AND minute(due_at) = minute(created_at) OR hour(due_at) = 0 AND minute(due_at) = 0 THEN date_trunc('day', due_at) + INTERVAL 9 HOUR ELSE date_trunc('minute', due_at) END AS due FROM reminders")
def due_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reminders").select("reminder_id", reminders.normalize_due(F.col("due_at"), F.lit("that day"), F.col("created_at")).alias("due"))


_phrases = ("tomorrow at 3pm", "in 2 hours", "on 2026-08-01", "tomorrow", "on Friday at 15:00", "in two weeks", "on 5 March", "March 5th at noon", "tonight", "next week")
_day = "date_trunc('day', created_at)"
_march = f"CASE WHEN make_timestamp(year(created_at), 3, 5, 0, 0, 0) < {_day} THEN make_timestamp(year(created_at) + 1, 3, 5, 0, 0, 0) ELSE make_timestamp(year(created_at), 3, 5, 0, 0, 0) END"


@query(
    rf"""WITH r AS (SELECT reminder_id, created_at, regexp_replace('errand ' || reminder_id || ': ' || coalesce(regexp_replace(title, '[^A-Za-z]+', '', 'g'), 'act'), '[\s,;.!-]+$', '') AS title FROM reminders)
 SELECT reminder_id, title, CASE reminder_id % 10 WHEN 0 THEN {_day} + INTERVAL 39 HOUR WHEN 1 THEN date_trunc('minute', created_at + INTERVAL 2 HOUR) WHEN 2 THEN TIMESTAMP '2026-08-01 09:00:00'
  WHEN 3 THEN {_day} + INTERVAL 33 HOUR WHEN 4 THEN {_day} + (CASE WHEN isodow(created_at) >= 5 THEN 12 - isodow(created_at) ELSE 5 - isodow(created_at) END) * INTERVAL 1 DAY + INTERVAL 15 HOUR
  WHEN 5 THEN {_day} + INTERVAL 14 DAY + INTERVAL 9 HOUR WHEN 6 THEN {_march} + INTERVAL 9 HOUR WHEN 7 THEN {_march} + INTERVAL 12 HOUR WHEN 8 THEN {_day} + INTERVAL 20 HOUR ELSE {_day} + INTERVAL 7 DAY + INTERVAL 9 HOUR END AS due_at FROM r"""
)
def reminder_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Each reminder's title with a time expression behind it, read at the time of its creation."""
    when = F.array(*[F.lit(x) for x in _phrases])
    name = F.coalesce(F.regexp_replace("title", "[^A-Za-z]+", ""), F.lit("act"))
    rows = table(spark, folder, "reminders").select("reminder_id", F.concat(F.lit("remind me to errand "), "reminder_id", F.lit(": "), name, F.lit(", "), F.element_at(when, (F.col("reminder_id") % 10 + 1).cast("int"))).alias("text"), F.col("created_at").alias("now"))
    return reminders.parse(rows).select("reminder_id", "title", "due_at")
