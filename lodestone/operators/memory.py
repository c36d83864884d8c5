"""Conversation and semantic memory, the fact graph, and the result cache as operators over tables."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clamp, query_tokens
from lodestone.sources.tables import cut


def ascii_lower(x: Column) -> Column:
    """Lower case of A to Z only, as keys of names and facts are compared."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def newest(turns: DataFrame, keep: int = 10, by: str | None = None) -> DataFrame:
    """The ``keep`` turns with the highest ids, of all or of each ``by``; rows repeated under one id count once; only those
    of users and assistants."""
    own = turns.where(F.col("role").isin("user", "assistant")).dropDuplicates(["turn_id"])
    if by is None:
        return own.orderBy(F.desc("turn_id")).limit(keep)
    order = Window.partitionBy(by).orderBy(F.desc("turn_id"))
    return own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def most_important(items: DataFrame, keep: int = 100, by: str | None = None) -> DataFrame:
    """The ``keep`` items ``item_id, importance, created_at`` of highest importance, then newest, then highest id; importance is
    clamped to 0..1 and null counts as 0.5."""
    own = items.withColumn("importance", clamp(F.coalesce("importance", F.lit(0.5))))
    keys = [F.desc("importance"), F.desc_nulls_last("created_at"), F.desc("item_id")]
    if by is None:
        return own.orderBy(*keys).limit(keep)
    order = Window.partitionBy(by).orderBy(*keys)
    return own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def search(items: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """``qid, place, item_id, overlap``: for each question the items that share most distinct words with it, then the more
    important, then the lower id. Items meet questions by common words; those without any fill up, of which only the first
    ``limit`` can be needed."""
    asked = questions.select("qid", query_tokens(F.coalesce("question", F.lit(""))).alias("_q"))
    kept = cut(items.select("item_id", "importance", query_tokens(F.coalesce("text", F.lit(""))).alias("_t")))
    hits = asked.select("qid", F.explode("_q").alias("word")).join(kept.select("item_id", "importance", F.explode("_t").alias("word")), "word")
    shared = hits.groupBy("qid", "item_id", "importance").agg(F.count(F.lit(1)).alias("overlap"))
    first = kept.orderBy(F.desc("importance"), "item_id").limit(limit).select("item_id", "importance").collect()  # ``limit`` rows
    fill = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["importance"]).alias("importance")) for r in first]) if first else None
    if fill is not None:
        spare = asked.select("qid", F.explode(fill).alias("i")).select("qid", "i.item_id", "i.importance", F.lit(0).cast("long").alias("overlap"))
        shared = shared.unionByName(spare).groupBy("qid", "item_id", "importance").agg(F.max("overlap").alias("overlap"))
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), F.desc("importance"), "item_id")
    return shared.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).select("qid", "place", "item_id", "overlap")


def merge_facts(rows: DataFrame) -> DataFrame:
    """One fact of each subject, predicate and object (compared without A-Z case) of ``seq, subject, predicate, object,
    confidence, source``: the highest confidence (clamped, null is 1), the last source that isn't null, writing and
    ``created_seq`` of the first. Rows with a null or blank part are dropped."""
    parts = ("subject", "predicate", "object")
    own = rows.withColumns({p: F.trim(p) for p in parts})
    for p in parts:
        own = own.where(F.length(p) > 0)
    own = own.withColumns({f"{p}_key": ascii_lower(F.col(p)) for p in parts}).withColumn("confidence", clamp(F.coalesce("confidence", F.lit(1.0))))
    known = F.when(F.col("source").isNotNull(), F.col("seq"))
    return own.groupBy(*[f"{p}_key" for p in parts]).agg(
        *[F.min_by(p, "seq").alias(p) for p in parts], F.max("confidence").alias("confidence"), F.max_by("source", known).alias("source"), F.min("seq").alias("created_seq"),
    )


def merge_entities(rows: DataFrame) -> DataFrame:
    """One entity of each name (compared without A-Z case) of ``seq, name, entity_type, description``: of type and
    description the last that isn't null, writing of the first, first and last ``seq``."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.where("name is not null").groupBy(ascii_lower(F.col("name")).alias("name_key")).agg(F.min_by("name", "seq").alias("name"), last("entity_type"), last("description"), F.min("seq").alias("created_seq"), F.max("seq").alias("updated_seq"))


def query_facts(facts: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """Facts with the given parts (without A-Z case; nulls don't filter), surest first."""
    for name, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if value is not None:
            facts = facts.where(ascii_lower(F.col(name)) == ascii_lower(F.lit(value)))
    if least > 0:
        facts = facts.where(F.col("confidence") >= least)
    facts = facts.orderBy(F.desc("confidence"), "fact_id")
    return facts.limit(limit) if limit is not None else facts


def related(facts: DataFrame, starts: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
    """``start, fact_id, confidence, rank``: for each ``start`` the facts that touch a name reached within ``depth`` steps over
    facts in either direction, surest first, then by id. No step goes back to a name already reached; depth 0 has none."""
    edge = F.array(F.struct(ascii_lower(F.col("subject")).alias("a"), ascii_lower(F.col("object")).alias("b")), F.struct(ascii_lower(F.col("object")).alias("a"), ascii_lower(F.col("subject")).alias("b")))
    edges = facts.select("fact_id", "confidence", F.explode(edge).alias("e")).select("fact_id", "confidence", F.col("e.a").alias("name"), F.col("e.b").alias("other"))
    seen = starts.select("start", ascii_lower(F.trim("start")).alias("name")).where(F.length("name") > 0).distinct()
    front, hits = seen, None
    for step in range(depth):
        touched = front.join(edges, "name")
        found = touched.select("start", "fact_id", "confidence").distinct()
        hits = found if hits is None else hits.unionByName(found)
        if step + 1 < depth:
            front = cut(touched.select("start", F.col("other").alias("name")).distinct().join(seen, ["start", "name"], "left_anti"))
            seen = cut(seen.unionByName(front))
    if hits is None:
        return seen.select("start", F.lit(0).cast("long").alias("fact_id"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("rank")).where("false")
    order = Window.partitionBy("start").orderBy(F.desc("confidence"), "fact_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def fact_candidates(facts: DataFrame, terms: DataFrame, limit: int = 50, first: int = 0) -> DataFrame:
    """Facts around a question's key terms (``qid, term``) as rows of its pool: ``qid, place, chunk_id`` (the negative fact id),
    ``score`` (its confidence), ``text``; each once a question, places after ``first``."""
    asked = terms.select("qid", "term", ascii_lower(F.trim("term")).alias("key")).dropDuplicates(["qid", "key"])
    hits = related(facts, asked.select(F.col("key").alias("start")).distinct(), 1, limit)
    rows = asked.join(hits, asked["key"] == hits["start"]).select("qid", "fact_id").distinct().join(facts.select("fact_id", "subject", "predicate", "object", F.col("confidence").alias("score")), "fact_id")
    order = Window.partitionBy("qid").orderBy("fact_id")
    return rows.select("qid", (F.row_number().over(order) + first).cast("long").alias("place"), (-F.col("fact_id")).alias("chunk_id"), "score", F.concat_ws(" ", "subject", "predicate", "object").alias("text"))


def fact_stats(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("facts"), F.coalesce(F.round(F.avg("confidence"), 6), F.lit(0.0)).alias("mean_confidence"))


def replay_ttl(requests: DataFrame, ttl_s: float = 3600.0, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """``requests`` with ``hit``: whether an unbounded cache answers, in which each miss stores the answer for ``ttl_s``.

    ``ts`` orders a key's requests, ``seq`` those at one time; an entry is stale once its time lies before the request's. A
    key's requests are one sequence, so a key is one group; its batches are streamed, only one row is kept.
    """
    names = [*keys, "ts", "seq"]
    source = requests.select(*names).repartition(*keys).sortWithinPartitions(*keys, "ts", "seq")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, expires, life = None, None, pd.Timedelta(seconds=ttl_s).value
        for pdf in batches:
            hits = np.zeros(len(pdf), bool)
            at = pdf["ts"].astype("datetime64[ns]").astype("int64").to_numpy()
            groups = pdf[list(keys)].apply(tuple, axis=1) if len(keys) > 1 else pdf[keys[0]]
            edges = np.flatnonzero(np.r_[True, groups.to_numpy()[1:] != groups.to_numpy()[:-1], True]) if len(pdf) else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = groups.iloc[low]
                first = int(np.searchsorted(at[low:high], expires, "right")) + low if key == now else low
                hits[low:first] = True  # by what the batch before left
                now, expires = key, expires if key == now else None
                while first < high:  # from one miss to the next
                    expires = at[first] + life
                    after = int(np.searchsorted(at[first:high], expires, "right")) + first
                    hits[first + 1 : after] = True
                    first = max(after, first + 1)
            yield pdf.assign(hit=hits)

    return source.mapInPandas(run, f"{kinds}, hit boolean")


class ResultCache:
    """The live cache of a driver: exact question, least recently used first out, time to live, and the snapshot's number."""

    def __init__(self, max_size: int = 1000, ttl_s: float = 3600.0):
        self.max_size, self.ttl_s = max_size, ttl_s
        self.hits = self.misses = 0
        self.rows: OrderedDict[str, tuple[object, float, int | None]] = OrderedDict()

    def get(self, question: str, now: float, generation: int | None = None):
        row = self.rows.get(question)
        if row is not None and row[1] >= now and (generation is None or row[2] == generation):
            self.rows.move_to_end(question)
            self.hits += 1
            return row[0]
        self.rows.pop(question, None)
        self.misses += 1
        return None

    def put(self, question: str, answer, now: float, ttl_s: float | None = None, generation: int | None = None) -> None:
        self.rows.pop(question, None)
        self.rows[question] = (answer, now + (self.ttl_s if ttl_s is None else ttl_s), generation)
        while len(self.rows) > self.max_size:
            self.rows.popitem(last=False)

    def clear(self) -> None:
        self.rows.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.rows), "max_size": self.max_size, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


def replay_lru(requests: DataFrame, max_size: int = 1000, ttl_s: float = 3600.0, by: str = "shard") -> DataFrame:
    """Counts of a bounded cache for each ``by``, one cache each: ``by, hits, misses, size``. Evictions hang on the order of all
    requests of a shard, so a shard is one sequence, read in batches; the cache is all that is kept."""
    source = requests.select(by, "key", "ts", "seq").repartition(by).sortWithinPartitions(by, "ts", "seq")
    kind = source.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, now = None, None

        def row() -> pd.DataFrame:
            return pd.DataFrame({by: [now], "hits": [cache.hits], "misses": [cache.misses], "size": [len(cache.rows)]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if cache is None or r[0] != now:
                    if cache is not None:
                        yield row()
                    cache, now = ResultCache(max_size, ttl_s), r[0]
                at = r.ts.timestamp()
                if cache.get(r.key, at) is None:
                    cache.put(r.key, True, at)
        if cache is not None:
            yield row()

    return source.mapInPandas(run, f"`{by}` {kind}, hits long, misses long, size long")
