"""Queries of ranking, fusion, packing and answering. Questions are the turns whose id is divisible by 100, in ``answer_one_pass`` and ``answer_by_parts`` all turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import context, memory, search
from lodestone.plans.answer import answer_in_parts, answer_remembered, answer_single, cached, finalise_cache, finalise_turns, summarize
from lodestone.settings import Settings
from lodestone.sources.tables import cut, once, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "chunks", "chunk_id", ["chunk_id", "doc_id", "chunk_idx", "text", "char_start", "char_end", "page"])


def questions(spark: SparkSession, folder: str, which: str = "turn_id % 100 = 0") -> DataFrame:
    turns = table(spark, folder, "conversation_turns").where(which).where("content is not null")
    turns = turns.repartition(spark.sparkContext.defaultParallelism, "turn_id")  # few bytes, which would be cut into words by one task
    return turns.dropDuplicates(["turn_id"]).select(F.col("turn_id").alias("qid"), F.col("content").alias("question"))


def every_question(spark: SparkSession, folder: str) -> DataFrame:
    """All turns that have an id and content."""
    return questions(spark, folder, "turn_id is not null")


def thirds(asked: DataFrame) -> DataFrame:
    """Each question as up to three sub-questions, ``qid`` * 10 + 0..2."""
    words = asked.select("qid", F.regexp_extract_all("question", F.lit(r"\S+"), F.lit(0)).alias("w"))
    end = [F.floor((F.size("w") * sub + 2) / 3).cast("int") for sub in range(4)]  # word i is of part floor(i * 3 / words)
    parts = [F.array_join(F.slice("w", a + 1, b - a), " ") for a, b in zip(end, end[1:])]
    rows = words.select("qid", F.posexplode(F.array(*parts)).alias("sub", "question"))
    return rows.select((F.col("qid") * 10 + F.col("sub")).alias("qid"), "question").where("question <> ''")


FOLD = f"translate(lower(%s), '{X.FOLD_FROM}', '{X.FOLD_TO}')"
CH = "ch AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, chunk_idx, text, char_start, char_end, page FROM chunks WHERE chunk_id IS NOT NULL)"
QS = "qs AS (SELECT DISTINCT ON (turn_id) turn_id AS qid, content AS question FROM conversation_turns WHERE turn_id % 100 = 0 AND content IS NOT NULL)"
THIRDS = r"""subs AS (SELECT qid * 10 + sub AS qid, array_to_string(list_filter(w, lambda x, i: floor((i - 1) * 3.0 / len(w)) = sub), ' ') AS question
  FROM (SELECT qid, regexp_extract_all(question, '\S+') AS w, unnest([0, 1, 2]) AS sub FROM qs)), thirds AS (SELECT * FROM subs WHERE question <> '')"""


def bm25_ctes(source: str, k: int = 8) -> str:
    return rf"""wl AS (SELECT chunk_id, regexp_extract_all({FOLD % "text"}, '[\p{{L}}\p{{N}}]+') AS l FROM ch),
 wp AS (SELECT chunk_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM wl),
 dl AS (SELECT chunk_id, coalesce(len(l), 0) AS dl FROM wl),
 st AS (SELECT count(*)::DOUBLE AS n_all, avg(dl)::DOUBLE AS avgdl FROM dl),
 tk AS (SELECT qid, unnest(list_distinct(list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1))) AS token FROM {source}),
 ph AS (SELECT qid, terms, count(*) AS times FROM (SELECT qid, regexp_extract_all({FOLD % "token"}, '[\p{{L}}\p{{N}}]+') AS terms FROM tk) WHERE len(terms) > 0 GROUP BY ALL),
 pt AS (SELECT terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS ix FROM (SELECT DISTINCT terms FROM ph)),
 hit AS (SELECT terms, chunk_id, pos - ix AS start FROM pt JOIN wp USING (term) GROUP BY ALL HAVING count(*) = len(terms)),
 tf AS (SELECT terms, chunk_id, count(*)::DOUBLE AS tf FROM hit GROUP BY ALL),
 df AS (SELECT terms, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
 sc AS (SELECT qid, chunk_id, round(sum(times * greatest(ln((n_all - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
   FROM ph JOIN df USING (terms) JOIN tf USING (terms) JOIN dl USING (chunk_id), st GROUP BY ALL),
 kw AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= {k})"""


@query(f"WITH {CH}, {QS}, {bm25_ctes('qs')} SELECT qid, chunk_id, score, rank FROM kw")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25(chunks(spark, folder), questions(spark, folder))


_names = "names AS (SELECT doc_id AS qid, filename AS question FROM documents WHERE doc_id % 100 = 0)"


@query(f"WITH {CH}, {_names}, {bm25_ctes('names')} SELECT qid, chunk_id, score, rank FROM kw")
def bm25_phrases(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("filename").alias("question"))
    return search.bm25(chunks(spark, folder), names)


@query(
    """SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
 SELECT a.vec_id AS qid, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
 FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 8"""
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return search.cosine(vectors, vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), "embedding"))


def _places(name: str, source: str, key: str, text: str) -> str:
    digit = lambda n: f"(instr('0123456789abcdef', substr(h, {n}, 1)) - 1)"
    return rf"""{name}_w AS (SELECT {key} AS id, sha256(unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'))) AS h FROM {source}),
 {name}_n AS (SELECT id, (({digit(1)} * 4096 + {digit(2)} * 256 + {digit(3)} * 16 + {digit(4)}) % 48)::BIGINT AS place, sum(CASE WHEN {digit(5)} < 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS n FROM {name}_w GROUP BY ALL),
 {name} AS (SELECT id, place, n / nullif(sqrt(sum(n * n) OVER (PARTITION BY id)), 0) AS v FROM {name}_n)"""


@query(f"WITH {CH}, {_places('e', 'ch', 'chunk_id', 'text')} SELECT id AS chunk_id, place, round(v, 6) AS weight FROM e WHERE v <> 0")
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    made = search.hash_embedding(chunks(spark, folder), "chunk_id", "text")
    return made.select("chunk_id", F.posexplode("embedding").alias("place", "weight")).where("weight <> 0").select("chunk_id", F.col("place").cast("long").alias("place"), F.round("weight", 6).alias("weight"))


_hybrid = rf"""{bm25_ctes("qs")}, {_places("e", "ch", "chunk_id", "text")}, {_places("f", "qs", "qid", "question")},
 vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
   SELECT f.id AS qid, e.id AS chunk_id, round(sum(e.v * f.v), 6) AS score FROM f JOIN e USING (place) GROUP BY ALL)) WHERE rank <= 8),
 fused AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(first) AS first FROM (
   SELECT qid, chunk_id, rank, rank AS first FROM vec UNION ALL SELECT qid, chunk_id, rank, 1000 + rank FROM kw) GROUP BY ALL),
 fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM fused) WHERE rank <= 8)"""


def _hybrid_of(spark: SparkSession, folder: str) -> DataFrame:
    own, asked = chunks(spark, folder), questions(spark, folder)
    return search.hybrid(own, table(spark, folder, "documents"), asked, search.hash_embedding(own, "chunk_id", "text"), search.hash_embedding(asked, "qid", "question"))


@query(f"WITH {CH}, {QS}, {_hybrid} SELECT qid, chunk_id, score, rank FROM fz")
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    own, asked = chunks(spark, folder), questions(spark, folder)
    vec = search.cosine(search.hash_embedding(own, "chunk_id", "text"), search.hash_embedding(asked, "qid", "question"))
    return search.fuse([vec, search.bm25(own, asked)])


@query(
    f"""WITH {CH}, {QS}, {_hybrid} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS place, chunk_id, doc_id, filename, path, chunk_idx, page, text, score
 FROM fz JOIN ch USING (chunk_id) JOIN documents d USING (doc_id)""".replace("filename, path, chunk_idx, page, text, score", "d.filename, d.path, ch.chunk_idx, ch.page, ch.text, score")
)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid_of(spark, folder)


_pool = f"""{THIRDS}, {bm25_ctes("thirds")}, pl AS (SELECT qid // 10 AS qid, chunk_id, max(score) AS score, count(*) AS matches, min((qid % 10) * 1000 + rank) AS first FROM kw GROUP BY ALL),
 pool AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY matches DESC, score DESC, first, chunk_id) AS place, chunk_id, score, matches FROM pl) WHERE place <= 20)"""


def _pool_of(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.bm25(chunks(spark, folder), thirds(questions(spark, folder)))
    return search.merge_pools(hits.withColumn("sub", F.col("qid") % 10).withColumn("qid", F.floor(F.col("qid") / 10)))


@query(f"WITH {CH}, {QS}, {_pool} SELECT qid, place, chunk_id, score, matches FROM pool")
def subquery_pool_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _pool_of(spark, folder)


_evidence = f"""{_pool}, rel AS (SELECT *, CASE WHEN chunk_id % 7 <> 0 THEN least(1.0, (chunk_id % 13) / 10.0)::DOUBLE END AS relevance FROM pool),
 ev AS (SELECT *, max(CASE WHEN coalesce(relevance, 0) >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS good FROM rel),
 ek AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN good = 1 THEN -coalesce(relevance, 0) ELSE 0 END, place) AS n, place, chunk_id, score, relevance
   FROM ev WHERE (good = 1 AND coalesce(relevance, 0) >= 0.3) OR (good = 0 AND place <= 3)), evidence AS (SELECT * FROM ek WHERE n <= 12)"""


def _evidence_of(spark: SparkSession, folder: str) -> DataFrame:
    pool = cut(_pool_of(spark, folder))
    scores = pool.where("chunk_id % 7 <> 0").select("qid", "place", ((F.col("chunk_id") % 13) / 10.0).alias("relevance"), F.lit(1).alias("seq"))
    return search.filter_evidence(pool, scores)


@query(f"WITH {CH}, {QS}, {_evidence} SELECT qid, n, place, chunk_id, score, relevance FROM evidence")
def evidence_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence_of(spark, folder)


@query(f"WITH {CH}, {QS}, {_evidence} SELECT qid, round(avg(relevance), 6) AS confidence FROM evidence GROUP BY qid")
def evidence_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return context.confidence(_evidence_of(spark, folder))


_packed = f"""{bm25_ctes("qs")}, cost AS (SELECT kw.qid, kw.rank AS place, ch.*, greatest(1, length(text) // 4) + 20 AS cost FROM kw JOIN ch USING (chunk_id)),
 pk AS (SELECT * FROM (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY place)::BIGINT AS spent FROM cost) WHERE spent <= 900 OR place = 1)"""


def _packed_of(spark: SparkSession, folder: str) -> DataFrame:
    own = chunks(spark, folder)
    hits = search.bm25(own, questions(spark, folder)).withColumnRenamed("rank", "place")
    return context.pack(hits.join(search.found(own, hits), "chunk_id"), 900)


@query(f"WITH {CH}, {QS}, {_packed} SELECT qid, place, chunk_id, cost, spent FROM pk")
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _packed_of(spark, folder).select("qid", "place", "chunk_id", "cost", "spent")


@query(
    rf"""WITH {CH}, {QS}, {_packed}, inc AS (SELECT pk.qid, pk.place, d.filename, d.path, pk.page, pk.chunk_idx FROM pk JOIN documents d USING (doc_id)),
 ans AS (SELECT qid, CASE WHEN qid % 200 = 0 THEN 'See [2], [1] and [9] or [1].' ELSE 'No marks [0] [77].' END AS answer FROM qs),
 mk AS (SELECT a.qid, list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::INT), lambda x: x > 0 AND x <= m) AS marks FROM ans a JOIN (SELECT qid, max(place) AS m FROM inc GROUP BY qid) USING (qid)),
 us AS (SELECT inc.*, row_number() OVER (PARTITION BY qid, path, page ORDER BY place) AS k FROM inc JOIN mk USING (qid) WHERE len(marks) = 0 OR list_contains(marks, place))
 SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY place) AS source_no, filename, path, page, chunk_idx FROM us WHERE k = 1"""
)
def citations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "filename", "path")
    included = cut(_packed_of(spark, folder).join(docs, "doc_id").select("qid", "place", "filename", "path", "page", "chunk_idx"))
    answers = questions(spark, folder).select("qid", F.when(F.col("qid") % 200 == 0, "See [2], [1] and [9] or [1].").otherwise("No marks [0] [77].").alias("answer"))
    return context.citations(included, answers)


@query(
    f"""WITH {CH}, b AS (SELECT chunk_id, '[' || (chunk_idx + 1) || '] (' || filename || CASE WHEN coalesce(page, 0) <> 0 THEN ', page ' || page ELSE ', section ' || (chunk_idx + 1) END || ')' || chr(10) || ch.text AS block
 FROM ch JOIN documents d USING (doc_id)) SELECT chunk_id, length(block) AS n, md5(block) AS digest FROM b"""
)
def context_block(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks(spark, folder).join(table(spark, folder, "documents").select("doc_id", "filename"), "doc_id")
    block = X.context_block(F.col("chunk_idx") + 1, F.col("filename"), F.col("page"), F.col("chunk_idx"), F.col("text"))
    return rows.select("chunk_id", F.length(block).cast("long").alias("n"), F.md5(block).alias("digest"))


_conj = " OR ".join(f"contains(' ' || lower(content) || ' ', '{c}')" for c in (" and ", " as well as ", " along with ", " & ", " plus "))


@query(
    rf"""WITH t AS (SELECT DISTINCT ON (turn_id) turn_id, content, len(regexp_extract_all(content, '\S+')) AS w FROM conversation_turns WHERE content IS NOT NULL)
 SELECT turn_id, CASE WHEN w < 8 THEN false WHEN w > 30 THEN true ELSE length(content) - length(replace(content, '?', '')) > 1 OR regexp_matches(content, '(?:^|\s)\d[.)]\s') OR {_conj} END AS many FROM t"""
)
def question_gate(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversation_turns").where("content is not null").dropDuplicates(["turn_id"])
    return turns.select("turn_id", X.needs_parts(F.col("content")).alias("many"))


@query("SELECT DISTINCT turn_id, CASE WHEN starts_with(content, 'The ') THEN 'NOT_FOUND' ELSE content END AS answer FROM conversation_turns WHERE role = 'assistant' AND content IS NOT NULL")
def not_found(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that begin with the sentinel are it; here those that begin with 'The ' are given it first."""
    said = table(spark, folder, "conversation_turns").where("role = 'assistant' and content is not null")
    said = said.select("turn_id", F.when(F.col("content").startswith("The "), F.concat(F.lit(X.NOT_FOUND), F.lit(" in the excerpts"))).otherwise(F.col("content")).alias("a"))
    return said.select("turn_id", F.when(X.is_not_found(F.col("a")), X.NOT_FOUND).otherwise(F.col("a")).alias("answer")).distinct()


_facts = """fr AS (SELECT n_nationkey * 2 AS seq, n_name AS subject, 'in region' AS predicate, r_name AS object, 0.5::DOUBLE AS confidence, NULL AS source FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT n_nationkey * 2 + 1, lower(n_name), 'In Region', r_name, 0.25 + (n_nationkey % 4) * 0.25, 'atlas' FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 1000 + s_suppkey, s_name, 'located in', n_name, 0.8, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 fm AS (SELECT lower(subject) AS subject_key, lower(predicate) AS predicate_key, lower(object) AS object_key, arg_min(subject, seq) AS subject, arg_min(predicate, seq) AS predicate, arg_min(object, seq) AS object,
   max(confidence) AS confidence, arg_max(source, seq) FILTER (source IS NOT NULL) AS source, min(seq) AS created_seq FROM fr GROUP BY ALL)"""


def fact_rows(spark: SparkSession, folder: str) -> DataFrame:
    nation, region, supplier = (table(spark, folder, t) for t in ("nation", "region", "supplier"))
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    key = F.col("n_nationkey").cast("long")
    none = F.lit(None).cast("string").alias("source")
    one = joined.select((key * 2).alias("seq"), F.col("n_name").alias("subject"), F.lit("in region").alias("predicate"), F.col("r_name").alias("object"), F.lit(0.5).alias("confidence"), none)
    two = joined.select((key * 2 + 1).alias("seq"), F.lower("n_name").alias("subject"), F.lit("In Region").alias("predicate"), F.col("r_name").alias("object"), (0.25 + (key % 4) * 0.25).alias("confidence"), F.lit("atlas").alias("source"))
    three = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select((F.lit(1000) + F.col("s_suppkey")).alias("seq"), F.col("s_name").alias("subject"), F.lit("located in").alias("predicate"), F.col("n_name").alias("object"), F.lit(0.8).alias("confidence"), none)
    return one.unionByName(two).unionByName(three)


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return memory.merge_facts(fact_rows(spark, folder)).withColumn("fact_id", F.col("created_seq"))


@query(
    f"""WITH {_facts}, {QS}, {THIRDS}, tm AS (SELECT DISTINCT r_regionkey AS qid, lower(r_name) AS term FROM region),
 hit AS (SELECT DISTINCT qid, created_seq AS fact_id, confidence, subject, predicate, object FROM tm JOIN fm ON term = subject_key OR term = object_key)
 SELECT qid::BIGINT AS qid, 20 + row_number() OVER (PARTITION BY qid ORDER BY fact_id) AS place, -fact_id AS chunk_id, confidence AS score, subject || ' ' || predicate || ' ' || object AS text FROM hit"""
)
def fact_candidates(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("qid"), F.col("r_name").alias("term"))
    return memory.fact_candidates(facts(spark, folder), terms, first=20)


@query()
def answer_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    return answer_single(every_question(spark, folder), chunks(spark, folder), table(spark, folder, "documents"))


@query()
def answer_by_parts(spark: SparkSession, folder: str) -> DataFrame:
    return answer_in_parts(every_question(spark, folder), chunks(spark, folder), table(spark, folder, "documents"), facts=facts(spark, folder))


#: Answers of an earlier time: of every second question, every third of an older generation, every fifth expired.
_stored = """stored AS (SELECT question, 'kept ' || qid AS answer, CASE WHEN qid % 300 = 0 THEN 6 ELSE 7 END AS generation, CASE WHEN qid % 500 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-06-01' END AS expires_at, qid AS used_seq
  FROM qs WHERE qid % 200 = 0 QUALIFY row_number() OVER (PARTITION BY question ORDER BY qid DESC) = 1)"""
_hits = "hits AS (SELECT qid, answer FROM qs JOIN stored USING (question) WHERE generation = 7 AND expires_at >= TIMESTAMP '2024-03-20 12:00:00')"


def stored_answers(asked: DataFrame) -> DataFrame:
    newest = asked.where("qid % 200 = 0").groupBy("question").agg(F.max("qid").alias("qid"))
    empty = F.lit(None).cast("array<struct<source_no:long,filename:string,path:string,page:int,chunk_idx:int>>")
    return newest.select("question", F.concat(F.lit("kept "), "qid").alias("answer"), empty.alias("sources"), F.when(F.col("qid") % 300 == 0, 6).otherwise(7).cast("long").alias("generation"), F.when(F.col("qid") % 500 == 0, "2024-01-01").otherwise("2024-06-01").cast("timestamp_ntz").alias("expires_at"), F.col("qid").alias("used_seq"))


def _now():
    return F.lit("2024-03-20 12:00:00").cast("timestamp_ntz")


@query(f"WITH {QS}, {_stored}, {_hits} SELECT qid, answer FROM hits")
def answers_cached(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    return cached(asked, stored_answers(asked), _now(), 7).select("qid", "answer")


@query(
    f"""WITH {QS}, {_stored}, {_hits}, fresh AS (SELECT question, 'new ' || max(qid) AS answer, max(qid) AS by_ FROM qs WHERE qid NOT IN (SELECT qid FROM hits) GROUP BY question),
 kept AS (SELECT s.*, (SELECT max(qid) FROM hits h JOIN qs USING (qid) WHERE qs.question = s.question) AS by_ FROM stored s WHERE question NOT IN (SELECT question FROM fresh)),
 moved AS (SELECT question, answer, 7 AS generation, TIMESTAMP '2024-03-20 13:00:00' AS expires_at, by_ FROM fresh UNION ALL SELECT question, answer, generation, expires_at, by_ FROM kept WHERE by_ IS NOT NULL),
 everything AS (SELECT question, answer, generation, expires_at, used_seq FROM kept WHERE by_ IS NULL
  UNION ALL SELECT question, answer, generation, expires_at, (SELECT coalesce(max(used_seq), 0) FROM stored) + row_number() OVER (ORDER BY by_) FROM moved)
 SELECT question, answer, generation::BIGINT AS generation, expires_at, used_seq FROM everything ORDER BY used_seq DESC LIMIT 50"""
)
def cache_finalised(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of 50 answers after all questions were asked; those that it didn't hold are answered anew."""
    asked = questions(spark, folder)
    kept = stored_answers(asked)
    hits = cached(asked, kept, _now(), 7)
    made = asked.join(hits.select("qid"), "qid", "left_anti").select("qid", F.concat(F.lit("new "), F.max("qid").over(Window.partitionBy("question"))).alias("answer"), F.lit(None).cast(kept.schema["sources"].dataType).alias("sources"))
    return finalise_cache(asked, made, hits.select("qid"), kept, _now(), 7, Settings(cache_max_size=50)).drop("sources")


@query(
    f"""WITH {QS}, t AS (SELECT DISTINCT turn_id, role, content, created_at FROM conversation_turns), new AS (SELECT qid, unnest([0, 1]) AS n, question FROM qs)
 SELECT turn_id, role, content FROM t UNION ALL SELECT (SELECT max(turn_id) FROM t) + row_number() OVER (ORDER BY qid, n), CASE WHEN n = 0 THEN 'user' ELSE 'assistant' END, CASE WHEN n = 0 THEN question ELSE 'said ' || qid END FROM new"""
)
def turns_finalised(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    turns = table(spark, folder, "conversation_turns").select("turn_id", "role", "content", "created_at").distinct()
    return finalise_turns(asked, asked.select("qid", F.concat(F.lit("said "), "qid").alias("answer")), turns, _now()).select("turn_id", "role", "content")


@query()
def answer_with_memory(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    turns = table(spark, folder, "conversation_turns").select("turn_id", "role", "content", "created_at").distinct()
    items = turns.where("content is not null").select(F.col("turn_id").alias("item_id"), F.col("content").alias("text"), F.lit(0.5).alias("importance"), "created_at")
    made, _, _ = answer_remembered(asked, chunks(spark, folder), table(spark, folder, "documents"), turns, memory.most_important(items), stored_answers(asked), _now(), 7)
    return made


@query()
def document_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return summarize(table(spark, folder, "documents"))
