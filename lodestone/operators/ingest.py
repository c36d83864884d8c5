"""Change detection against the last snapshot, and the snapshot's next state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.access import ancestors, resolve, under
from lodestone.sources.tables import numbered

SUPPORTED = (".md", ".txt", ".pdf", ".docx")


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SUPPORTED)


def visible(path: Column, root: str) -> Column:
    """Whether no part of ``path`` below ``root`` begins with a dot."""
    below = F.substring(path, len(root.rstrip("/")) + 1, 1 << 30)
    return ~below.rlike(r"/\.")


def classify(listing: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """``path, action`` of each listed file: ``unchanged`` (time and size as known, not read), ``touched`` (read, same hash;
    only time and size change), ``updated`` or ``added``.

    A known file in error is read again and, when it can be read, ``updated``; ``force`` reads and replaces everything.
    ``listing`` has ``path, mtime, size, content_hash``, ``known`` also ``status``. A path must be listed once.
    """
    old = known.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("content_hash").alias("_hash"), F.col("status").alias("_status"))
    fine = (F.col("_status") == "ok") & F.lit(not force)
    action = (
        F.when(fine & (F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size")), "unchanged")
        .when(fine & (F.col("content_hash") == F.col("_hash")), "touched")
        .when(F.col("_status").isNotNull(), "updated")
        .otherwise("added")
    )
    return listing.join(old, "path", "left").select("path", action.alias("action"))


def blocked(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """``path`` of the listed files that may not be read."""
    return resolve(listing, folders).where(F.col("access_level") == "no_access").select("path")


def pruned(known: DataFrame, seen: DataFrame, roots: list[str]) -> DataFrame:
    """``doc_id, path`` of known documents below a scanned folder that weren't seen."""
    below = reduce(lambda a, b: a | b, [under(F.col("path"), r) for r in roots], F.lit(False))
    return known.where(below).join(seen.select("path").distinct(), "path", "left_anti").select("doc_id", "path")


def report(actions: DataFrame) -> DataFrame:
    """One row: how many files were added, updated, skipped, removed, blocked and failed."""
    count = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(count("added").alias("added"), count("updated").alias("updated"), count("unchanged", "touched").alias("skipped"), count("removed").alias("removed"), count("blocked").alias("blocked"), count("failed").alias("failed"))


def merge_documents(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """``known`` with the rows of ``fresh`` by path: a known path keeps its id and takes all other columns, a new one gets
    ids after the highest, by path. Both have the same columns; ``fresh`` has each path once, its ids are not used."""
    rest = [c for c in known.columns if c not in ("doc_id", "path")]
    top = known.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    kept = known.join(fresh.select("path"), "path", "left_anti")
    again = fresh.select("path", *rest).join(known.select("path", "doc_id"), "path")
    new = fresh.select("path", *rest).join(known.select("path"), "path", "left_anti")
    cols = known.columns
    return kept.select(cols).unionByName(again.select(cols)).unionByName(numbered(new, ["path"], top, "doc_id").select(cols))


def refresh_stats(known: DataFrame, listing: DataFrame, actions: DataFrame) -> DataFrame:
    """``known`` with time and size of the ``touched`` files as listed."""
    touched = listing.join(actions.where("action = 'touched'"), "path", "left_semi").select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    return known.join(touched, "path", "left").withColumn("mtime", F.coalesce("_mtime", "mtime")).withColumn("size", F.coalesce("_size", "size")).select(known.columns)


def record_failures(known: DataFrame, failures: DataFrame) -> DataFrame:
    """``known`` with the documents of ``failures`` (``path, error``) in status error and without hash."""
    bad = failures.select("path", F.col("error").alias("_error"))
    hit = F.col("_error").isNotNull()
    made = known.join(bad, "path", "left").withColumn("status", F.when(hit, "error").otherwise(F.col("status"))).withColumn("content_hash", F.when(hit, "").otherwise(F.col("content_hash")))
    return made.withColumn("error", F.coalesce("_error", "error")).select(known.columns)


def number_chunks(fresh: DataFrame, chunks: DataFrame) -> DataFrame:
    """``fresh`` with ids after the highest of ``chunks``, in order of document and place."""
    top = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
    return numbered(fresh, ["doc_id", "chunk_idx"], top, "chunk_id")


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` without those of the documents in ``fresh``, plus the rows of ``fresh`` under new ids."""
    kept = chunks.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select(chunks.columns).unionByName(number_chunks(fresh, chunks).select(chunks.columns))


def cascade(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """``chunks`` without those of the documents ``gone``."""
    return chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(chunks.columns)


def in_folders(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """Distinct documents below any of ``folders``."""
    hit = documents.select("doc_id", F.explode(ancestors(F.col("path"))).alias("_folder")).join(folders.select(F.col("path").alias("_folder")).distinct(), "_folder", "left_semi")
    return documents.join(hit.select("doc_id").distinct(), "doc_id", "left_semi")
