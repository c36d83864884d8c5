"""Parquet tables of one folder, and helpers on how a job is laid out."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(spark: SparkSession, folder: str, name: str, key: str, columns: list[str], few: int = 100_000) -> DataFrame:
    """``columns`` of a table, one row of each ``key`` that isn't null. Rows aren't moved for it: only keys that are there twice
    are looked at, whose first row by file and place is kept; up to ``few`` of them are broadcast."""
    rows = table(spark, folder, name).where(F.col(key).isNotNull()).select(*columns, F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    twice = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    small = twice.limit(few + 1).count() <= few
    first = cut(rows.select(key, "_at").join(F.broadcast(twice) if small else twice, key).groupBy(key).agg(F.min("_at").alias("_first")))
    kept = rows.join(F.broadcast(first) if small else first, key, "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("_at")))
    return kept.select(*columns)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` in at least one partition a core, for CPU-heavy stages over a table of few files; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, so later stages neither recompute it nor lose it.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set a temporary one serves a local session; on a
    cluster, whose executors share no such folder, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle and checkpoint files of steps that are over go now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list[str], after: int, name: str) -> DataFrame:
    """``df`` with the column ``name``: the numbers after ``after`` in the given order, without gaps and each once.

    Ranges of rows are numbered on their own and moved up by the sizes of the ranges before, so no task sees all rows. The
    ranges are written first: their bounds come from a sample, and would differ if they were computed again.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), within.alias("_at")))
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    offsets, at = [], after + 1
    for part in sorted(sizes):
        offsets.append((part, at))
        at += sizes[part]
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _from long")
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_from")).drop("_range", "_at", "_from")
