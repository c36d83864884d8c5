"""Problem 7: mixing sources to target shares by pivotal rounding of fractional copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tokens import VOCABULARY, count_tokens
from lodestone.sources.tables import cut

#: Documents in a leaf of the reduction tree, and leaves or nodes that one node joins.
LEAF, FAN = 20_000, 256


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source of ``targets``: its tokens, its target and the copies each of its documents gets on average.

    The mix is as large as all documents of all listed sources, each once. A source whose tokens times ``max_repeats`` are
    below its share of that is ``short``: all its documents are used ``max_repeats`` times. Null sources are in no list, a
    listed source without documents has 0 tokens, and a null share or repeat counts as 0.
    """
    listed = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source is not null")
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    found = F.broadcast(listed).join(per, "source", "left").fillna(0, ["tokens", "documents"])  # one row a listed source
    every = Window.partitionBy(F.lit(1))  # as many rows as sources are listed
    want = F.col("target_share") * F.col("total")
    return (
        found.withColumn("total", F.sum("tokens").over(every))
        .withColumn("short", F.col("tokens") * F.col("max_repeats") < want)
        .withColumn("copies", F.when(F.col("short"), F.col("max_repeats").cast("double")).when(F.col("tokens") > 0, F.least(want / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    )


def _draw(level: int) -> Column:
    """A number in 0..1 from the row's key, another one on each level of the tree."""
    return F.pmod(F.xxhash64(F.lit(level), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pivot(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds the column ``part``: of two fractions one gives tokens to the other until one of them is 0 or 1, and which of
    the two gives is drawn so that both keep their mean. At most one row keeps a fraction, the sum in tokens stays.

    The draw is a hash of the row's key, so a task that runs again makes the same choices.
    """
    rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
    part, size, draw = rows["part"].to_numpy().copy(), rows["tokens"].to_numpy(), rows["draw"].to_numpy()
    held = -1
    for i in range(len(rows)):
        if not 0.0 < part[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min((1 - part[held]) * a, part[i] * b), min(part[held] * a, (1 - part[i]) * b)
        moved = up if draw[i] * (up + down) < down else -down
        part[held], part[i] = part[held] + moved / a, part[i] - moved / b
        for j in (held, i):
            if min(part[j], 1 - part[j]) * size[j] < 1e-6:
                part[j] = round(part[j])
        held = i if 0.0 < part[i] < 1.0 else held if 0.0 < part[held] < 1.0 else -1
    rows["part"] = part
    return rows


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """How often each document of the listed sources is used (``doc_id, source, tokens, copies``), and the ``plan``.

    Every document gets the whole part of its source's mean copies, and one more by pivotal rounding of the fraction: in
    leaves of about ``LEAF`` documents of one source (a large source has many), then the one fraction left of each leaf
    with those of ``FAN`` leaves, and so on up a tree; the last one is drawn. So the tokens of a source miss its target by
    less than one document. Documents without tokens, and rows with a null ``doc_id`` or an unlisted source, get no extra
    copy; repeated rows are documents of their own.
    """
    names = targets.select("source").where("source is not null").distinct()
    own = documents.select("doc_id", "source", "text").join(F.broadcast(names), "source", "left_semi")
    sizes = cut(count_tokens(own, vocabulary=vocabulary, keep=("doc_id", "source")))
    made = plan(sizes, targets)
    rows = (
        sizes.join(F.broadcast(made.select("source", "copies", "documents")), "source")
        .withColumn("whole", F.floor("copies"))
        .withColumn("part", F.when(F.col("tokens") > 0, F.col("copies") - F.col("whole")).otherwise(0.0))
        .withColumn("draw", _draw(0))
        .withColumn("leaf", F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("documents") / LEAF))))
        .drop("copies", "documents")
    )
    kinds = "source string, doc_id long, tokens long, whole long, part double, draw double, leaf long"
    rows = rows.select("source", "doc_id", "tokens", "whole", "part", "draw", "leaf")
    done = cut(rows.groupBy("source", "leaf").applyInPandas(_pivot, kinds))
    fraction = (F.col("part") > 0) & (F.col("part") < 1)
    whole, left = done.where(~fraction), done.where(fraction)
    width = made.agg(F.max(F.ceil(F.col("documents") / LEAF))).first()[0] or 1
    level = 0
    while width > 1:  # one turn for documents up to LEAF * FAN in a source, two up to LEAF * FAN ** 2
        width, level = -(-width // FAN), level + 1
        left = cut(left.withColumn("leaf", F.floor(F.col("leaf") / FAN)).withColumn("draw", _draw(level)).groupBy("source", "leaf").applyInPandas(_pivot, kinds))
        whole, left = whole.unionByName(left.where(~fraction)), left.where(fraction)
    last = left.withColumn("part", (_draw(-1) < F.col("part")).cast("double"))
    used = whole.unionByName(last).select("doc_id", "source", "tokens", (F.col("whole") + F.round("part")).cast("long").alias("copies"))
    return used, made


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a listed source: target and actual share of the mix's tokens, documents used, most copies, and ``short``."""
    used, made = mix(documents, targets, vocabulary)
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.sum((F.col("copies") > 0).cast("long")).alias("used"), F.max("copies").alias("most"))
    joined = made.join(F.broadcast(got), "source", "left").fillna(0, ["mixed", "used", "most"])  # one row a listed source
    whole = F.sum("mixed").over(Window.partitionBy(F.lit(1)))
    share = F.when(whole > 0, F.col("mixed") / whole).otherwise(0.0)
    return joined.select("source", "target_share", share.alias("actual_share"), "tokens", "documents", "mixed", "used", "most", "short")
