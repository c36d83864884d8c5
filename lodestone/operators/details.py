"""Coarse personal details by patterns, model findings located in the text, and spans merged."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import spread

#: Patterns in their order, which decides between equal spans. Fixed values.
PATTERNS = (
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("phone", r"(?<![\w./-])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,6}){1,3}(?![\w-])|(?<![\w./-])\+\d{7,15}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card_or_account", r"\b(?:\d[ -]?){13,19}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("account_number", r"\b\d{8,12}\b"),
    ("ip_address", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
)
#: Those that a column expression can count, over ASCII.
COUNTED = {
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]",
    "iban": r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"(?:^|[^A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "account_number": r"(?:^|[^A-Za-z0-9])[0-9]{8,12}",
    "ip_address": r"(?:^|[^A-Za-z0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}


def merge_spans(spans: DataFrame, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Spans without those that lie within another of the same ``keys``: sorted by start, then longest, then ``seq``, a span
    stays if it ends after all before it. Spans with null ends are dropped."""
    order = Window.partitionBy(*keys).orderBy("span_start", F.desc("span_end"), "seq")
    before = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.where("span_start is not null and span_end is not null").withColumn("_before", before).where("_before is null or span_end > _before").drop("_before")


def scan(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, span_start, span_end, text, kind, source`` of the merged findings of all patterns in each text."""
    compiled = [(kind, re.compile(p)) for kind, p in PATTERNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = sorted(((m.start(), -m.end(), n, m) for n, (_, p) in enumerate(compiled) for m in p.finditer(text)), key=lambda h: h[:3])
                far = -1
                for start, end, n, m in hits:
                    if -end > far:
                        far = -end
                        rows.append((i, start, far, m.group(), compiled[n][0], "regex"))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["key", "span_start", "span_end", "text", "kind", "source"])

    source = spread(chunks.where("text is not null").select(F.col(key).cast("long"), "text"))
    return source.mapInArrow(run, "key long, span_start int, span_end int, text string, kind string, source string").withColumnRenamed("key", key)


def counts(text: Column) -> list[Column]:
    return [F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("long").alias(kind) for kind, p in COUNTED.items()]


def _places(text: pd.Series, needle: pd.Series) -> pd.Series:
    """One search after another from the place behind the last hit."""
    out = []
    for t, n in zip(text, needle, strict=True):
        n = (n or "").strip(" ")
        at, own = (t or "").find(n) if n else -1, []
        while at >= 0:
            own.append(at)
            at = t.find(n, at + 1)
        out.append(own)
    return pd.Series(out, dtype=object)


def occurrences(text: Column, needle: Column) -> Column:
    """Starts (0-based) of all, also overlapping, places of the trimmed ``needle``; none if it is blank."""
    return F.pandas_udf(_places, "array<int>")(text, needle)


def model_spans(texts: DataFrame, answers: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Spans of what the model quoted (JSON ``{"items": [{"text", "kind"}]}`` in ``answers.answer``); what isn't in the text
    vanishes, malformed answers have no items, a missing kind is ``other``."""
    items = F.from_json("answer", "items array<struct<text string, kind string>>")["items"]
    quoted = answers.select(key, F.explode(items).alias("i")).select(key, F.trim("i.text").alias("quote"), F.coalesce("i.kind", F.lit("other")).alias("kind"))
    joined = texts.select(key, "text").join(quoted, key)
    found = joined.select(key, "kind", "quote", F.explode(occurrences(F.col("text"), F.col("quote"))).alias("span_start"))
    return found.select(key, "span_start", (F.col("span_start") + F.length("quote")).alias("span_end"), F.col("quote").alias("text"), "kind", F.lit("model").alias("source"))


def combined(texts: DataFrame, answers: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """Findings of the patterns and of the model (``key, answer``; none where it failed or wasn't asked), merged: of spans that lie
    within one another the longer stays, of equal ones the pattern's."""
    found = scan(texts, key)
    if answers is not None:
        found = found.unionByName(model_spans(texts, answers, key))
    return merge_spans(found.withColumn("seq", F.when(F.col("source") == "regex", 0).otherwise(1)), (key,)).drop("seq")


def actions(answers: DataFrame, key: str = "qid") -> DataFrame:
    """Action items of the model's JSON: blank tasks dropped, blank owner and date are null, snippets trimmed."""
    items = F.from_json("answer", "items array<struct<task string, owner string, due_date string, source_snippet string>>")["items"]
    rows = answers.select(key, F.posexplode(items).alias("item_no", "i"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(key, "item_no", F.trim("i.task").alias("task"), blank("i.owner").alias("owner"), blank("i.due_date").alias("due_date"), F.trim(F.coalesce("i.source_snippet", F.lit(""))).alias("source_snippet")).where("task <> ''")


def stated_facts(answers: DataFrame, key: str = "qid") -> DataFrame:
    """Facts of the model's JSON: parts trimmed, incomplete ones dropped, confidence 1 if none is given, clamped."""
    items = F.from_json("answer", "facts array<struct<subject string, predicate string, object string, confidence double>>")["facts"]
    rows = answers.select(key, F.posexplode(items).alias("fact_no", "f"))
    made = rows.select(key, "fact_no", *[F.trim(f"f.{p}").alias(p) for p in ("subject", "predicate", "object")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("f.confidence", F.lit(1.0)))).alias("confidence"))
    return made.where("subject <> '' and predicate <> '' and object <> ''")
