"""Queries over documents and chunks: chunking, reconstruction, listings, counts and coarse personal details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunking, details, ingest
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


@query("SELECT lang, count(*) AS documents, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, max(greatest(1, length(text) // 4))::BIGINT AS most FROM documents WHERE text IS NOT NULL GROUP BY lang")
def approx_tokens(spark: SparkSession, folder: str) -> DataFrame:
    n = X.approx_tokens(F.col("text"))
    return table(spark, folder, "documents").where("text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("tokens"), F.max(n).alias("most"))


@query(
    f"""WITH {CH} SELECT chunk_id, CASE WHEN char_start < 5 THEN 1 ELSE least((char_start - 5) // 1000 + 1, (n_chars + 999) // 1000) END::INT AS page_found
 FROM ch JOIN (SELECT doc_id, n_chars FROM documents WHERE n_chars > 0) USING (doc_id) WHERE char_start IS NOT NULL"""
)
def page_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of 1000 characters, the first at 5, the last at the end."""
    docs = table(spark, folder, "documents").where("n_chars > 0").select("doc_id", F.transform(F.sequence(F.lit(1), F.ceil(F.col("n_chars") / 1000)), lambda p: F.struct(p.cast("int").alias("page"), ((p - 1) * 1000 + 5).alias("start"))).alias("pages"))
    joined = chunks(spark, folder).where("char_start is not null").join(docs, "doc_id")
    return joined.select("chunk_id", chunking.page_lookup(F.col("pages"), F.col("char_start")).alias("page_found"))


@query()
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, folder, "documents"))


@query(r"SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS oversized, 0::BIGINT AS standing FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')")
def chunk_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Over all chunks: documents with letters that have one, and chunks that aren't the text at their offsets, are longer
    than the target, or don't begin after the one before. All must be 0."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("whole"))
    rows = chunking.chunk_documents(docs.withColumnRenamed("whole", "text")).join(docs.where(F.col("whole").rlike(r"[\p{L}\p{N}]")), "doc_id")
    at = F.col("whole").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    size = F.col("char_end") - F.col("char_start")
    before = rows.select("doc_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), F.col("char_start").alias("_start"))
    joined = rows.join(before, ["doc_id", "chunk_idx"], "left")
    return joined.agg(F.count_distinct("doc_id").alias("documents"), F.count_if(at != F.col("text")).alias("misplaced"), F.count_if(size > 1600).alias("oversized"), F.count_if(F.col("_start") >= F.col("char_start")).alias("standing"))


@query(
    f"""WITH {CH}, r AS (SELECT *, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ch
   WHERE char_start IS NOT NULL AND char_end IS NOT NULL AND text IS NOT NULL),
 k AS (SELECT *, coalesce(before, 0) AS e FROM r WHERE char_end > coalesce(before, 0))
 SELECT doc_id, chunk_id, greatest(char_start, e) AS fresh_start, char_end, before IS NOT NULL AND char_start > e AS gap, md5(substr(text, (greatest(char_start, e) - char_start + 1)::BIGINT)) AS digest FROM k"""
)
def reconstruct_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = chunking.fresh_parts(table(spark, folder, "chunks"))
    return parts.select("doc_id", "chunk_id", "fresh_start", "char_end", "gap", F.md5("fresh").alias("digest"))


@query(
    f"""WITH {CH}, r AS (SELECT *, coalesce(max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e,
   row_number() OVER (PARTITION BY doc_id ORDER BY char_start, chunk_id) AS k FROM ch WHERE char_start IS NOT NULL AND char_end IS NOT NULL AND text IS NOT NULL)
 SELECT doc_id, 0::BIGINT AS part, md5(string_agg(CASE WHEN k > 1 AND char_start > e THEN chr(10) || chr(10) ELSE '' END || substr(text, (greatest(char_start, e) - char_start + 1)::BIGINT), '' ORDER BY char_start, chunk_id)) AS digest
 FROM r WHERE char_end > e GROUP BY doc_id"""
)
def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.reconstruct(table(spark, folder, "chunks")).select("doc_id", "part", F.md5("text").alias("digest"))


@query(f"WITH {CH} SELECT d.doc_id, d.filename, d.status, count(chunk_id) AS chunk_count FROM documents d LEFT JOIN ch USING (doc_id) GROUP BY ALL")
def document_listing(spark: SparkSession, folder: str) -> DataFrame:
    counts = chunks(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    docs = table(spark, folder, "documents").select("doc_id", "filename", "status")
    return docs.join(counts, "doc_id", "left").select("doc_id", "filename", "status", F.coalesce("n", F.lit(0)).alias("chunk_count"))


@query(
    f"""WITH {CH} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE status = 'error') AS failed, (SELECT count(*) FROM ch) AS chunks,
 (SELECT count(*) FROM reminders WHERE status = 'pending') AS pending, (SELECT count(*) FROM folder_permissions) AS folders"""
)
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row of counts; each table is counted on its own and sent on as one number."""
    docs = table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "error").alias("failed"))
    rest = (
        chunks(spark, folder).agg(F.count(F.lit(1)).alias("chunks")),
        table(spark, folder, "reminders").agg(F.count_if(F.col("status") == "pending").alias("pending")),
        table(spark, folder, "folder_permissions").agg(F.count(F.lit(1)).alias("folders")),
    )
    made = docs.withColumn("_one", F.lit(1))
    for one in rest:
        made = made.join(one.withColumn("_one", F.lit(1)), "_one")
    return made.drop("_one")


@query(r"SELECT lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS extension, count(*) AS files, lower(regexp_extract(path, '(\.[^./]*)$', 1)) IN ('.md', '.txt', '.pdf', '.docx') AS supported FROM documents WHERE path IS NOT NULL GROUP BY ALL")
def supported_formats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("path is not null")
    return docs.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.first(ingest.supported(F.col("path"))).alias("supported"))


_counts = ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {kind}" for kind, p in details.COUNTED.items())


@query(f"WITH {CH} SELECT chunk_id, {_counts} FROM ch WHERE text IS NOT NULL")
def pii_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).where("text is not null").select("chunk_id", *details.counts(F.col("text")))


@query()
def pii_scan(spark: SparkSession, folder: str) -> DataFrame:
    return details.scan(chunks(spark, folder))


@query()
def pii_combined(spark: SparkSession, folder: str) -> DataFrame:
    """The patterns' findings and a model's, for which the spans of an earlier pass stand in."""
    item = F.struct(F.col("text"), F.col("kind"))
    said = table(spark, folder, "pii_spans").groupBy("chunk_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("answer"))
    return details.combined(chunks(spark, folder), said)


@query(
    """SELECT span_id, chunk_id, span_start, span_end, kind FROM (SELECT *, max(span_end) OVER (PARTITION BY chunk_id ORDER BY span_start, span_end DESC, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM pii_spans WHERE span_start IS NOT NULL AND span_end IS NOT NULL) WHERE before IS NULL OR span_end > before"""
)
def pii_merge(spark: SparkSession, folder: str) -> DataFrame:
    return details.merge_spans(table(spark, folder, "pii_spans").withColumn("seq", F.col("span_id"))).select("span_id", "chunk_id", "span_start", "span_end", "kind")


@query(
    f"""WITH {CH}, s AS (SELECT span_id, chunk_id, trim(pii_spans.text, ' ') AS needle, ch.text AS body FROM pii_spans JOIN ch USING (chunk_id)),
 o AS (SELECT span_id, list_filter(range(0, length(body)::BIGINT), lambda i: substr(body, i + 1, length(needle)) = needle) AS places FROM s WHERE length(needle) > 0)
 SELECT span_id, len(places)::BIGINT AS places, places[1]::INT AS first_place FROM o WHERE len(places) > 0"""
)
def pii_locate(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "pii_spans").select("span_id", "chunk_id", F.col("text").alias("needle"))
    found = chunks(spark, folder).join(spans, "chunk_id").select("span_id", details.occurrences(F.col("text"), F.col("needle")).alias("places"))
    return found.where(F.size("places") > 0).select("span_id", F.size("places").cast("long").alias("places"), F.element_at("places", 1).alias("first_place"))


@query(
    """SELECT reminder_id, trim(title, ' ') AS task, CASE WHEN status = 'done' THEN NULL ELSE status END AS owner, due_at::DATE::VARCHAR AS due_date, trim(coalesce(source_text, ''), ' ') AS source_snippet
 FROM reminders WHERE trim(title, ' ') <> ''"""
)
def actions_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Reminders as the model's JSON, read back as action items."""
    item = F.struct(F.concat(F.lit(" "), "title").alias("task"), F.when(F.col("status") == "done", " ").otherwise(F.col("status")).alias("owner"), F.date_format("due_at", "yyyy-MM-dd").alias("due_date"), F.col("source_text").alias("source_snippet"))
    said = table(spark, folder, "reminders").select("reminder_id", F.to_json(F.struct(F.array(item, F.struct(F.lit(" ").alias("task"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("due_date"), F.lit(None).cast("string").alias("source_snippet"))).alias("items"))).alias("answer"))
    return details.actions(said, "reminder_id").drop("item_no")


@query("SELECT n_nationkey::BIGINT AS qid, n_name AS subject, 'lies in' AS predicate, r_name AS object, least(1.0, n_nationkey / 10.0)::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey")
def facts_normalised(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    fact = lambda obj: F.struct(F.concat(F.lit(" "), "n_name").alias("subject"), F.lit("lies in ").alias("predicate"), obj.alias("object"), (F.col("n_nationkey") / 10.0).alias("confidence"))
    said = joined.select(F.col("n_nationkey").cast("long").alias("qid"), F.to_json(F.struct(F.array(fact(F.col("r_name")), fact(F.lit(" "))).alias("facts"))).alias("answer"))
    return details.stated_facts(said).drop("fact_no")
