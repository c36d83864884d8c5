"""Queries of access and ingest: the listing is made of the documents with some files changed, removed and added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import access, ingest
from lodestone.plans.search_queries import CH, chunks
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


_level = "lvl AS (SELECT d.doc_id, d.path, coalesce(arg_max(f.access_level, length(f.path)), 'edit') AS access_level FROM documents d LEFT JOIN folder_permissions f ON d.path = f.path OR starts_with(d.path, rtrim(f.path, '/') || '/') GROUP BY ALL)"


@query(f"WITH {_level} SELECT doc_id, path, access_level FROM lvl")
def acl_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return access.resolve(table(spark, folder, "documents").select("doc_id", "path"), table(spark, folder, "folder_permissions"))


@query(f"WITH {_level} SELECT access_level, count(*) AS documents, access_level = 'no_access' AS blocked FROM lvl GROUP BY ALL")
def acl_gate(spark: SparkSession, folder: str) -> DataFrame:
    fine, shut = access.gate(table(spark, folder, "documents").select("doc_id", "path"), table(spark, folder, "folder_permissions"))
    return fine.withColumn("blocked", F.lit(False)).unionByName(shut.withColumn("blocked", F.lit(True))).groupBy("access_level", "blocked").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {_level}, {CH}, n AS (SELECT doc_id, count(*) AS chunk_count FROM ch GROUP BY doc_id) SELECT doc_id, filename, access_level, coalesce(chunk_count, 0) AS chunk_count FROM lvl JOIN documents USING (doc_id) LEFT JOIN n USING (doc_id)")
def document_access(spark: SparkSession, folder: str) -> DataFrame:
    known = access.resolve(table(spark, folder, "documents").select("doc_id", "filename", "path"), table(spark, folder, "folder_permissions"))
    counts = chunks(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "doc_id", "left").select("doc_id", "filename", "access_level", F.coalesce("n", F.lit(0)).alias("chunk_count"))


@query("SELECT f.folder_id, f.path, count(d.doc_id) AS documents FROM folder_permissions f LEFT JOIN documents d ON d.path = f.path OR starts_with(d.path, rtrim(f.path, '/') || '/') GROUP BY ALL")
def folder_counts(spark: SparkSession, folder: str) -> DataFrame:
    return access.folder_counts(table(spark, folder, "documents"), table(spark, folder, "folder_permissions").select("folder_id", "path"))


@query(
    """WITH top AS (SELECT max(folder_id) AS m FROM folder_permissions),
 fresh AS (SELECT path || '/new' AS path, 'no_access' AS access_level, updated_at AS changed FROM folder_permissions WHERE folder_id % 7 = 0)
 SELECT folder_id, path, CASE WHEN folder_id % 5 = 0 THEN 'readonly' ELSE access_level END AS access_level, created_at, CASE WHEN folder_id % 5 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at FROM folder_permissions
 UNION ALL SELECT m + row_number() OVER (ORDER BY path), path, access_level, changed, changed FROM fresh, top"""
)
def acl_upsert(spark: SparkSession, folder: str) -> DataFrame:
    folders = table(spark, folder, "folder_permissions")
    set_again = folders.where("folder_id % 5 = 0").select("path", F.lit("readonly").alias("access_level"), (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("changed_at"))
    new = folders.where("folder_id % 7 = 0").select(F.concat("path", F.lit("/new")).alias("path"), F.lit("no_access").alias("access_level"), F.col("updated_at").alias("changed_at"))
    return access.set_levels(folders, set_again.unionByName(new))


@query("SELECT doc_id, path FROM documents d WHERE NOT EXISTS (SELECT 1 FROM folder_permissions f WHERE f.access_level = 'no_access' AND (d.path = f.path OR starts_with(d.path, rtrim(f.path, '/') || '/')))")
def acl_purge(spark: SparkSession, folder: str) -> DataFrame:
    shut = table(spark, folder, "folder_permissions").where("access_level = 'no_access'")
    return access.purge(table(spark, folder, "documents").select("doc_id", "path"), shut)


_list = """listing AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN doc_id % 11 = 0 THEN size + 1 ELSE size END AS size,
   CASE WHEN doc_id % 11 = 0 THEN 'edited' ELSE content_hash END AS content_hash FROM documents WHERE doc_id % 13 <> 0
 UNION ALL SELECT NULL, path || '.copy.md', mtime, size, content_hash FROM documents WHERE doc_id % 17 = 0),
 act AS (SELECT l.path, l.doc_id, l.mtime, l.size, l.content_hash, CASE WHEN d.status = 'ok' AND d.mtime = l.mtime AND d.size = l.size THEN 'unchanged' WHEN d.status = 'ok' AND d.content_hash = l.content_hash THEN 'touched'
   WHEN d.status IS NOT NULL THEN 'updated' ELSE 'added' END AS action FROM listing l LEFT JOIN documents d ON l.path = d.path)"""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    touched, edited = F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0
    old = docs.where("doc_id % 13 <> 0").select("path", F.when(touched | edited, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(edited, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(edited, "edited").otherwise(F.col("content_hash")).alias("content_hash"))
    return old.unionByName(docs.where("doc_id % 17 = 0").select(F.concat("path", F.lit(".copy.md")).alias("path"), "mtime", "size", "content_hash"))


@query(f"WITH {_list} SELECT path, action FROM act")
def cdc_classify(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.classify(listing(spark, folder), table(spark, folder, "documents"))


@query(f"WITH {_list} SELECT doc_id, path FROM documents WHERE starts_with(path, '/vault/') AND path NOT IN (SELECT path FROM listing)")
def cdc_prune(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.pruned(table(spark, folder, "documents"), listing(spark, folder), ["/vault"])


@query(
    f"""WITH {_list}, {_level}, la AS (SELECT a.path, a.action, coalesce(arg_max(f.access_level, length(f.path)), 'edit') AS lv FROM act a LEFT JOIN folder_permissions f ON a.path = f.path OR starts_with(a.path, rtrim(f.path, '/') || '/') GROUP BY ALL),
 st AS (SELECT path, CASE WHEN lv = 'no_access' THEN 'blocked' WHEN action IN ('added', 'updated') AND length(path) % 5 = 0 THEN 'failed' ELSE action END AS action FROM la)
 SELECT (SELECT count(*) FROM st WHERE action = 'added') AS added, (SELECT count(*) FROM st WHERE action = 'updated') AS updated, (SELECT count(*) FROM st WHERE action IN ('unchanged', 'touched')) AS skipped,
 (SELECT count(*) FROM documents WHERE path NOT IN (SELECT path FROM listing)) AS removed, (SELECT count(*) FROM st WHERE action = 'blocked') AS blocked, (SELECT count(*) FROM st WHERE action = 'failed') AS failed"""
)
def cdc_report(spark: SparkSession, folder: str) -> DataFrame:
    """Files in shut folders are blocked; of those that are read, paths of a length divisible by five are taken to be damaged."""
    gone = cdc_prune(spark, folder).select("path", F.lit("removed").alias("action"))
    fine, shut = access.gate(listing(spark, folder), table(spark, folder, "folder_permissions"))
    read = ingest.classify(fine.drop("access_level"), table(spark, folder, "documents"))
    damaged = F.col("action").isin("added", "updated") & (F.length("path") % 5 == 0)
    actions = read.withColumn("action", F.when(damaged, "failed").otherwise(F.col("action")))
    return ingest.report(actions.unionByName(shut.select("path", F.lit("blocked").alias("action"))).unionByName(gone))


@query(f"WITH {_level} SELECT DISTINCT path, access_level FROM lvl WHERE access_level <> 'edit'")
def force_locked(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a forced reading would be refused for."""
    return access.locked(table(spark, folder, "documents"), table(spark, folder, "folder_permissions"))


@query("SELECT folder_id, path, access_level FROM folder_permissions")
def folder_list(spark: SparkSession, folder: str) -> DataFrame:
    return access.listed(table(spark, folder, "folder_permissions")).select("folder_id", "path", "access_level")


@query(
    f"""WITH {_list}, top AS (SELECT max(doc_id) AS m FROM documents), ch AS (SELECT * FROM act WHERE action IN ('added', 'updated'))
 SELECT doc_id, path, mtime, size, content_hash FROM documents WHERE path NOT IN (SELECT path FROM ch)
 UNION ALL SELECT doc_id, path, mtime, size, content_hash FROM ch WHERE action = 'updated'
 UNION ALL SELECT m + row_number() OVER (ORDER BY path), path, mtime, size, content_hash FROM ch, top WHERE action = 'added'"""
)
def snapshot_merge(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "documents").select("doc_id", "path", "mtime", "size", "content_hash")
    changed = cdc_classify(spark, folder).where("action in ('added', 'updated')").select("path")
    fresh = listing(spark, folder).join(changed, "path", "left_semi").withColumn("doc_id", F.lit(0).cast("long"))
    return ingest.merge_documents(known, fresh)


@query(f"WITH {_list} SELECT d.doc_id, CASE WHEN action = 'touched' THEN a.mtime ELSE d.mtime END AS mtime, CASE WHEN action = 'touched' THEN a.size ELSE d.size END AS size FROM documents d LEFT JOIN act a USING (path)")
def refresh_stats(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "documents").select("doc_id", "path", "mtime", "size")
    return ingest.refresh_stats(known, listing(spark, folder), cdc_classify(spark, folder)).select("doc_id", "mtime", "size")


@query("SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'error' ELSE status END AS status, CASE WHEN doc_id % 19 = 0 THEN '' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 19 = 0 THEN 'damaged' ELSE error END AS error FROM documents")
def record_failures(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "documents").select("doc_id", "path", "status", "content_hash", "error")
    bad = known.where("doc_id % 19 = 0").select("path", F.lit("damaged").alias("error"))
    return ingest.record_failures(known, bad).select("doc_id", "status", "content_hash", "error")


@query(f"WITH {CH} SELECT chunk_id, doc_id, chunk_idx FROM ch WHERE doc_id % 50 <> 0 OR doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT m + row_number() OVER (ORDER BY doc_id), doc_id, 0 FROM documents, (SELECT max(chunk_id) AS m FROM ch) WHERE doc_id % 50 = 0")
def replace_chunks(spark: SparkSession, folder: str) -> DataFrame:
    own = chunks(spark, folder).select("chunk_id", "doc_id", "chunk_idx")
    fresh = table(spark, folder, "documents").where("doc_id % 50 = 0").select("doc_id", F.lit(0).alias("chunk_idx"))
    return ingest.replace_chunks(own, fresh)


@query(f"WITH {CH} SELECT chunk_id, doc_id FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 13 = 0)")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "documents").where("doc_id % 13 = 0").select("doc_id")
    return ingest.cascade(chunks(spark, folder).select("chunk_id", "doc_id"), gone)
