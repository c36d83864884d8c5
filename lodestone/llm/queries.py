"""The queries of the training-data problems, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import duplicates, levels, mix, neighbours, personal, pieces, scans, tokens
from lodestone.operators.search import cosine
from lodestone.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_spans(table(spark, folder, "chunks"))


def p1_masked(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return personal.details(chunks).select("chunk_id", F.size("found").alias("details"), "clean")


#: Words and similarity of p2's statement.
NEAR = {"width": 3, "similarity": 0.6, "least_words": 40}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = duplicates.pairs_of_rows(*duplicates.similar(table(spark, folder, "chunks"), **NEAR))
    return found.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.grouped(*duplicates.similar(table(spark, folder, "chunks"), **NEAR))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.nearest(table(spark, folder, "chunks"), table(spark, folder, "probe_chunks"))
    return found.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"))


def p3_all(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 100, among all."""
    chunks = table(spark, folder, "chunks")
    found = neighbours.nearest(chunks, chunks.where("chunk_id % 100 = 0"))
    return found.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), "rank")


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the queries of ``p3_all``, and whether at least 0.95 of their true neighbours, by comparison with all vectors,
    are found."""
    chunks = table(spark, folder, "chunks").where("size(embedding) = 64").select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    asked = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    true = cosine(chunks, asked, 11).where("qid <> chunk_id").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("n <= 10")
    found = p3_all(spark, folder).select(F.col("chunk_id").alias("qid"), F.col("neighbour_id").alias("chunk_id"), F.lit(1).alias("hit"))
    joined = true.join(found, ["qid", "chunk_id"], "left")
    return joined.agg(F.count_distinct("qid").alias("queries"), (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("enough"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(table(spark, folder, "chunks")).where("piece = 0").select("chunk_id", "break_kind")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return pieces.paged(pieces.split_oversized(chunks), chunks)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noises(table(spark, folder, "chunks"))


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scanned(table(spark, folder, "chunks")).select("chunk_id", "page", F.size("noises").alias("noises"), "repaired")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Length and digest of each text after encoding and decoding."""
    made = tokens.decode_column(tokens.encode_column(table(spark, folder, "documents")))
    return made.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shares(table(spark, folder, "documents"), table(spark, folder, "source_targets")).where("short").select("source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shares(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return levels.levels(table(spark, folder, "documents"), table(spark, folder, "level_samples")).select("doc_id", "level").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_groups, p3_found, p3_all, p3_recall, p4_found, p4_pieces, p5_found, p5_repaired, p6_ids, p6_round_trip, p7_found, p7_shares, p8_found)}

_CH = "ch AS (SELECT DISTINCT ON (chunk_id) chunk_id, text, embedding FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)"
_gap = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
_line = r"(?:\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}])"
_blank = rf"{_line}(?:[\t \x1c-\x1f\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}])*{_line}"
_fits = "list_max(list_transform(regexp_split_to_array({0}, '{1}'), lambda x: length(x))) <= 1600"

SQL: dict[str, str] = {
    "p2_found": rf"""WITH {_CH}, w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM ch),
 sh AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 40),
 n AS (SELECT chunk_id, count(*) AS n FROM sh GROUP BY chunk_id),
 both_have AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL)
 SELECT x AS chunk_id_a, y AS chunk_id_b FROM both_have JOIN n p ON p.chunk_id = x JOIN n q ON q.chunk_id = y WHERE c / (p.n + q.n - c) >= 0.6""",
    "p3_found": """WITH v AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding::DOUBLE[] AS e FROM chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 64),
 u AS (SELECT * FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0)
 SELECT chunk_id, neighbour_id FROM (SELECT a.chunk_id, b.chunk_id AS neighbour_id, row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.chunk_id) AS k
  FROM u a JOIN (SELECT DISTINCT chunk_id FROM probe_chunks) USING (chunk_id) JOIN u b ON a.chunk_id <> b.chunk_id) WHERE k <= 10""",
    "p6_round_trip": "SELECT doc_id, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS digest FROM documents",
    "p3_recall": "SELECT count(DISTINCT chunk_id) AS queries, true AS enough FROM chunks WHERE chunk_id % 100 = 0 AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0",
    "p4_found": rf"""WITH {_CH}, t AS (SELECT chunk_id, regexp_replace(text, '^{_gap}+|{_gap}+$', '', 'g') AS t FROM ch), big AS (SELECT * FROM t WHERE length(t) > 1600)
 SELECT chunk_id, CASE WHEN {_fits.format("t", _blank)} THEN 'paragraph' WHEN {_fits.format(f"regexp_replace(t, '([.!?]){_gap}', '" + chr(92) + "1' || chr(10), 'g')", _line)} THEN 'sentence'
  WHEN {_fits.format("t", _gap)} THEN 'word' ELSE 'none' END AS break_kind FROM big""",
}
