"""The ingest of folders into a store, from listing to committed generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import access, ingest, search
from lodestone.operators.chunking import chunk_documents
from lodestone.plans.answer import embed
from lodestone.plans.model import Model, OfflineModel
from lodestone.settings import Settings
from lodestone.sources import files
from lodestone.sources.store import Store
from lodestone.sources.tables import cut


def ingest_paths(store: Store, roots: list[str], model: Model | None = None, settings: Settings | None = None, force: bool = False, prune: bool = True, opened=None) -> dict:
    """Brings ``store`` up to the files below ``roots`` and returns the report.

    Files that are as known are not opened (``opened``, an accumulator, counts those that are); a file whose parsing fails or
    that has no text is recorded and loses its chunks, the others go on; files in folders without access are counted and not
    opened; documents whose files are gone from a scanned folder are removed, those that only aren't listed any more (hidden,
    blocked) stay. ``force`` reads everything again; each root must then allow editing. A root that doesn't exist is an error.
    A generation is committed only if something changed, and only buckets of chunks that did are written. All chunks of a
    store must be embedded by one model: another one is refused.
    """
    spark: SparkSession = store.spark
    model, s = model or OfflineModel(), settings or Settings()
    folders = files.folders_of(spark, roots)
    if force:
        may_edit(store, roots)
    space = [type(model).__name__, len(model.embed(["dimension"])[0])]
    if (known_space := store.meta("space")) and known_space != space:
        raise ValueError(f"the store was embedded by {known_space}, not by {space}")
    documents, chunks = store.table("documents"), store.table("chunks")
    listed = cut(files.listing(spark, roots))
    readable, shut = access.gate(listed, store.table("folder_permissions"))
    known = documents.select("path", "mtime", "size", "content_hash", "status")
    first = ingest.classify(readable.withColumn("content_hash", F.lit(None).cast("string")), known, force)
    unread = first.where("action = 'unchanged'").select("path")
    wanted = readable.join(unread, "path", "left_anti")
    read = cut(files.extract(wanted, opened).join(wanted.select("path", "mtime", "size"), "path"))
    read = read.withColumn("error", F.when(F.col("error").isNull() & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "no content").otherwise(F.col("error")))
    failed = read.where("error is not null")
    actions = cut(
        ingest.classify(read.where("error is null"), known, force)
        .unionByName(unread.withColumn("action", F.lit("unchanged")))
        .unionByName(failed.select("path", F.lit("failed").alias("action")))
        .unionByName(shut.select("path", F.lit("blocked").alias("action")))
    )
    gone = documents.select("doc_id", "path").where("false")
    if prune and folders:
        gone = files.missing(ingest.pruned(documents, listed, folders))
    gone = cut(gone)
    counts = ingest.report(actions.unionByName(gone.select("path", F.lit("removed").alias("action")))).first().asDict()
    touched = actions.where("action = 'touched'").limit(1).count() > 0
    if not any(counts[k] for k in ("added", "updated", "removed", "failed")) and not touched:
        return counts | {"generation": store.generation}
    fresh = read.join(actions.where("action in ('added', 'updated')"), "path", "left_semi")
    now = F.current_timestamp().cast("timestamp_ntz")
    row = lambda df, status, error: df.select(
        F.lit(0).cast("long").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.when(F.lit(status == "ok"), F.col("content_hash")).otherwise("").alias("content_hash"),
        "mtime", F.col("size").cast("long").alias("size"), F.lit(status).alias("status"), error.alias("error"), now.alias("ingested_at"),
    )
    kept = ingest.refresh_stats(documents.join(gone.select("doc_id"), "doc_id", "left_anti").select(documents.columns), listed, actions)
    merged = cut(ingest.merge_documents(kept, row(fresh, "ok", F.lit(None).cast("string")).unionByName(row(failed, "error", F.col("error")))))
    ids = merged.select("path", "doc_id")
    pieces = chunk_documents(fresh.join(ids, "path").select("doc_id", "text", "pages"), s.chunk_target_tokens, s.chunk_overlap_ratio)
    pieces = ingest.number_chunks(pieces, chunks)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda sum_, x: sum_ + x * x))
    made = cut(pieces.join(embed(pieces, "chunk_id", "text", model, model.document_prefix), "chunk_id").withColumn("norm", norm))
    index = search.postings(made).join(made.select("chunk_id", "doc_id"), "chunk_id")
    dropped = gone.select("doc_id").unionByName(read.join(actions.where("action in ('added', 'updated', 'failed')"), "path", "left_semi").join(ids, "path").select("doc_id"))
    generation = store.commit({"documents": merged}, {"space": space, "content": store.meta("content", 0) + 1}, {"chunks": (dropped, made.select(chunks.columns)), "postings": (dropped, index.select(store.table("postings").columns))})
    return counts | {"generation": generation}


def may_edit(store: Store, paths: list[str]) -> None:
    """An error unless every path's folder allows editing."""
    asked = store.spark.createDataFrame([(files.plain(p),) for p in paths], "path string")
    locked = [r["path"] for r in access.locked(asked, store.table("folder_permissions")).collect()]  # of the given paths
    if locked:
        raise PermissionError(f"editing isn't allowed: {locked}")


def set_access(store: Store, changes: DataFrame) -> int:
    """Sets levels of folders (``path, access_level, changed_at``); folders without access lose their documents at once."""
    folders = access.set_levels(store.table("folder_permissions"), changes)
    shut = changes.where("access_level = 'no_access'").select("path")
    documents = store.table("documents")
    kept = access.purge(documents, shut)
    gone = documents.join(kept.select("doc_id"), "doc_id", "left_anti")
    gone = cut(gone.select("doc_id"))
    return store.commit({"folder_permissions": folders, "documents": kept.select(documents.columns)}, {"content": store.meta("content", 0) + 1}, {t: (gone, store.table(t).limit(0)) for t in ("chunks", "postings")})


def delete_document(store: Store, doc_id: int) -> int:
    """Removes a document and its chunks; its folder must allow editing."""
    documents = store.table("documents")
    own = documents.where(F.col("doc_id") == doc_id).first()
    if own is None:
        raise KeyError(f"no document {doc_id}")
    may_edit(store, [own["path"]])
    gone = documents.where(F.col("doc_id") == doc_id).select("doc_id")
    return store.commit({"documents": documents.where(F.col("doc_id") != doc_id)}, {"content": store.meta("content", 0) + 1}, {t: (gone, store.table(t).limit(0)) for t in ("chunks", "postings")})
