import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions.text import raw_terms
from lodestone.operators import context, search
from lodestone.plans import model, search_queries
from lodestone.plans.model import signed_words


def by_hand(docs, question, k):
    terms = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, terms.values())) / len(docs)
    scores = Counter()
    for q in dict.fromkeys(x for x in re.findall(r"\w+", question.lower()) if len(x) > 1):
        tf = {i: w.count(q) for i, w in terms.items() if q in w}
        idf = max(1e-6, math.log((n - len(tf) + 0.5) / (len(tf) + 0.5)))
        for i, f in tf.items():
            scores[i] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(terms[i]) / avg))
    return [i for i, s in sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))][:k]


def test_bm25_against_the_formula(spark):
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choice(vocab[: rng.randint(3, 50)]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    qs = [(q, " ".join(rng.choice(vocab) for _ in range(6))) for q in range(15)] + [(99, ""), (98, None), (97, "zzz x")]
    got = search.bm25(spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(qs, "qid long, question string")).orderBy("qid", "rank").collect()
    for q, text in qs:
        assert [r["chunk_id"] for r in got if r["qid"] == q] == (by_hand(docs, text or "", 8)), q


def test_bm25_in_blocks_and_from_a_stored_index(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 5} foo bar" if i % 3 else f"bar foo common x{i}") for i in range(60)], "chunk_id long, text string")
    qs = spark.createDataFrame([(q, f"common word{q} foo_bar") for q in range(9)], "qid long, question string")
    want = sorted(map(tuple, search.bm25(docs, qs).collect()))
    assert len(want) == 72
    monkeypatch.setattr(search, "SMALL", 5)
    assert sorted(map(tuple, search.bm25(docs, qs).collect())) == want
    assert sorted(map(tuple, search.bm25(None, qs, index=search.postings(docs)).collect())) == want


def moved(spark):
    """Rows that all stages so far wrote for others."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_moves_no_hits_and_counts_equal_questions_once(spark, monkeypatch):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(600)] + [(i, f"same {i % 2}") for i in range(600, 640)]
    qs = [(q, " ".join(rng.choice(vocab) for _ in range(12))) for q in range(40)] + [(q, "same") for q in range(40, 45)]
    chunks, asked = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(qs, "qid long, question string")
    for sizes in ({}, {"CHUNKS": 7, "GROUP": 3, "ASKED": 200}):
        for name, n in sizes.items():
            monkeypatch.setattr(search, name, n)
        before = moved(spark)
        got = sorted(map(tuple, search.bm25(chunks, asked).select("qid", "rank", "chunk_id").collect()))
        assert moved(spark) - before < 640 * 8 or sizes  # hits and pairs are far more
        assert got == [(q, n, i) for q, text in qs for n, i in enumerate(by_hand(docs, text, 8), 1)]


def test_bm25_goes_ahead_with_a_part_and_hands_on_what_reaches_its_scores(spark, monkeypatch):
    rng = random.Random(5)
    kinds = [[f"{kind}{i}" for i in range(40)] for kind in "abc"]
    docs = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(1, 30)))) for i in range(3000)] + [(i, "a1 a2 b1 same") for i in range(3000, 3020)] + [(9000, None)]
    rng.shuffle(docs)
    qs = [(q, " ".join(rng.choice(kinds[q % 3]) for _ in range(6))) for q in range(60)] + [(99, "a1 a2 same"), (98, "same"), (97, "zzz"), (96, "a1 a2 same")]
    chunks, asked = spark.createDataFrame(docs, "chunk_id long, text string").repartition(40).cache(), spark.createDataFrame(qs, "qid long, question string")
    assert chunks.count() == len(docs)
    want = [(q, n, i) for q, text in sorted(qs) for n, i in enumerate(by_hand([(i, t or "") for i, t in docs], text, 8), 1)]
    monkeypatch.setattr(search, "PAIRS", 1)
    for sizes in ({}, {"AHEAD": 5, "CHUNKS": 40, "GROUP": 3}):
        for name, n in sizes.items():
            monkeypatch.setattr(search, name, n)
        before = moved(spark)
        assert sorted(map(tuple, search.bm25(chunks, asked).select("qid", "rank", "chunk_id").collect())) == want
        assert moved(spark) - before < 40 * 63 * 8 * 2 / 3  # every part would hand on eight a question


def test_bm25_spares_questions_that_chunks_cannot_serve():
    made = search._Questions([[(0, 1.0), (1, 2.0)], [(2, 3.0)], [(1, 2.0), (2, 3.0)]], np.array([5.0, 4.0, 3.0]), 10.0)
    best = search._Best(made, 2, np.array([4.0, 0.5, 4.0])[made.order])
    kept = []
    best._keep = lambda asked, *_: kept.extend(made.order[q] for q in asked)
    best.meet(np.arange(3), np.full(3, 10), np.array([0, 1, 2, 3]), np.array([0, 1, 2]), np.array([1, 1, 1]))
    assert kept == [1]


def test_vectors_of_texts_and_their_neighbours_move_little(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(15)) if i else None) for i in range(800)], "chunk_id long, text string").repartition(4).cache()
    docs.count()
    before, batch = moved(spark), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        vectors = search.hash_embedding(docs, "chunk_id", "text")
        rows = {r["chunk_id"]: r["embedding"] for r in vectors.collect()}
        assert moved(spark) == before and rows[0] == [0.0] * 48
        words = {r["chunk_id"]: r["text"] for r in docs.collect()}
        assert all(np.allclose(rows[i], signed_words(words[i] or "")) for i in rows)
        got = search.cosine(vectors, vectors.where("chunk_id % 100 = 1").withColumnRenamed("chunk_id", "qid"), 3).collect()
        assert moved(spark) - before <= 4 * 8 * 3 + 16  # a task hands on three rows a query
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    x = np.array([rows[i] for i in range(800)])
    for q in range(1, 800, 100):
        s = np.round(x @ x[q], 6)
        assert [r["chunk_id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == [int(i) for i in np.lexsort((np.arange(800), -s))[:3]]


def test_offline_embedding_hashes_a_word_once():
    model._place.cache_clear()
    made = [signed_words(f"one two {'two' * (i % 2)} one") for i in range(50)]
    assert model._place.cache_info().misses == 2 and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in made) and not any(signed_words(""))


def test_offline_embedding_looks_at_texts_together(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abC _é²ß中١-.İ\n😀") for _ in range(rng.choice([0, 3, 40]))) for _ in range(200)] + ["", "--", "x y x", "X_y"]
    want = [signed_words(t) for t in texts]
    monkeypatch.setattr(model, "signed_words", None)
    assert model.OfflineModel().embed(texts) == want and model.OfflineModel().embed([]) == []


def test_texts_of_hits_are_the_only_ones_moved(spark):
    chunks = spark.range(500).selectExpr("id AS chunk_id", "'text' AS text")
    hits = spark.createDataFrame([(1, 7), (2, 7), (1, 300)], "qid long, chunk_id long")
    before = moved(spark)
    assert sorted(r["chunk_id"] for r in search.found(chunks, hits).collect()) == [7, 300]
    assert moved(spark) - before < 50


def test_bm25_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "foo bar")], "chunk_id long, text string"), spark.createDataFrame([], "chunk_id long, text string")
    asked, silent = spark.createDataFrame([(1, "foo")], "qid long, question string"), spark.createDataFrame([(1, "- ")], "qid long, question string")
    assert len(search.bm25(docs, asked).collect()) == len(search.bm25(None, asked, index=search.postings(docs)).collect()) == 1
    for chunks, qs in ((none, asked), (docs, silent), (none, silent)):
        assert not search.bm25(chunks, qs).collect() and not search.bm25(None, qs, index=search.postings(chunks)).collect()


def test_bm25_phrases_and_marks(spark):
    docs = spark.createDataFrame([(1, "foo bar baz"), (2, "bar foo"), (3, "Café crème"), (4, None), (5, "other text here")], "chunk_id long, text string")
    qs = spark.createDataFrame([(1, "foo_bar"), (2, "cafe"), (3, "CRÈME")], "qid long, question string")
    assert {(r["qid"], r["chunk_id"]) for r in search.bm25(docs, qs).collect()} == {(1, 1), (2, 3), (3, 3)}


def test_cosine_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    vec = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    qs = vec.where("chunk_id % 50 = 0 or chunk_id = 901").withColumnRenamed("chunk_id", "qid")
    got = sorted(map(tuple, search.cosine(vec, qs, 5).collect()))
    n = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 300, 50):
        s = np.round(n @ n[q], 6)
        assert [r[1] for r in sorted((r for r in got if r[0] == q), key=lambda r: r[3])] == [int(i) for i in np.lexsort((np.arange(300), -s))[:5]]
    assert 901 not in {r[0] for r in got}
    monkeypatch.setattr(search, "SENT", 300)
    again = sorted(map(tuple, search.cosine(vec, qs, 5).collect()))
    assert [r[:2] for r in again] == [r[:2] for r in got]


def test_neighbours_closer_than_single_precision_keep_their_order():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 8))
    x[100:200] = x[0] + rng.standard_normal((100, 8)) * 1e-4
    x[500:900] = x[1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    score, own = np.full((50, 8), -np.inf), np.zeros((50, 8), np.int64)
    for lo in range(0, 3000, 700):
        search._near(x[:50], x[lo : lo + 700], np.arange(lo, min(lo + 700, 3000)), score, own)
    s = np.round(x[:50] @ x.T, 6)
    assert all(own[q].tolist() == np.lexsort((np.arange(3000), -s[q]))[:8].tolist() for q in range(50))


def test_fusion_prefers_what_both_found(spark):
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "qid long, chunk_id long, rank long") for x in ([1, 2, 3], [3, 4, 5])]
    assert [r["chunk_id"] for r in search.fuse(lists).orderBy("rank").collect()] == [3, 1, 2, 4, 5]


def test_evidence_fallback_clamp_and_last_score(spark):
    pool = spark.createDataFrame([(q, p, 10 * q + p, 0.5) for q in (1, 2) for p in range(1, 6)], "qid long, place long, chunk_id long, score double")
    scores = spark.createDataFrame([(1, 2, 0.1, 1), (1, 2, 7.0, 2), (1, 4, 0.3, 3), (1, 99, 1.0, 4), (2, 1, 0.1, 1), (1, 5, None, 5)], "qid long, place long, relevance double, seq int")
    rows = search.filter_evidence(pool, scores).orderBy("qid", "n").collect()
    assert [(r["place"], r["relevance"]) for r in rows if r["qid"] == 1] == [(2, 1.0), (4, 0.3)]
    assert [r["place"] for r in rows if r["qid"] == 2] == [1, 2, 3]


def test_packing_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 9000), (1, 2, "b"), (2, 1, "c" * 40), (2, 2, "d" * 9000), (2, 3, "e"), (3, 1, None)], "qid long, place long, text string")
    assert {(r["qid"], r["place"]) for r in context.pack(rows, 100).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_citations(spark):
    inc = spark.createDataFrame([(1, 1, "f", "/f", None, 0), (1, 2, "f", "/f", None, 1), (1, 3, "g", "/g", 2, 0)], "qid long, place long, filename string, path string, page int, chunk_idx int")
    cited = lambda a: [(r["path"], r["chunk_idx"]) for r in context.citations(inc, spark.createDataFrame([(1, a)], "qid long, answer string")).orderBy("source_no").collect()]
    assert cited("see [3] and [2]") == [("/f", 1), ("/g", 0)] and cited("[7]") == [("/f", 0), ("/g", 0)]


def test_memory_within_budget(spark):
    turns = spark.createDataFrame([(1, i, "user", "x" * 200) for i in range(10)] + [(2, 1, "user", "y" * 4000)], "qid long, seq long, role string, content string")
    facts = spark.createDataFrame([(q, p, "z" * 100) for q in (1, 2, 3) for p in range(1, 8)], "qid long, place long, text string")
    got = {r["qid"]: r["context"] for r in context.bounded_memory(turns, facts, spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "qid long")).collect()}
    assert got[1].count("user:") == 5 and got[1].count("known:") == 5 and got[2].count("known:") == 0 and got[3].startswith("Remembered") and got[4] == ""


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_bytes_are_those_of_the_pattern(spark):
    rng = random.Random(3)
    pool = "abz09 _-.,äÉßñ–’„中١𝐀😀İǅ́²Ⅷ\n�ჿ\U0001f130"
    texts = ["".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 9, 60]))) for _ in range(400)] + [None, "", "a" * 500, "end", "next"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    want = [r["w"] for r in rows.orderBy("chunk_id").select(F.coalesce(raw_terms(F.col("text")), F.array().cast("array<string>")).alias("w")).collect()]
    lower = pa.array([r["l"] for r in rows.orderBy("chunk_id").select(F.lower(F.coalesce("text", F.lit(""))).alias("l")).collect()])
    for own, expected in ((lower, want), (lower.slice(7, 90), want[7:97]), (lower.slice(401, 1), [[]]), (lower.slice(3, 0), [])):
        n, words = search.words_of(own, search._letters())
        assert n.tolist() == list(map(len, expected)) and words.to_pylist() == [w for x in expected for w in x]
    assert "regexp_extract_all" not in plan(search.hash_embedding(rows, "chunk_id", "text"))
    n, words = search.words_of(pa.array(["a\0b", "\0", "é\0\0c"]), search._letters())
    assert n.tolist() == [2, 0, 2] and words.to_pylist() == ["a", "b", "é", "c"]


def test_only_beginnings_of_longer_phrases_look_for_the_next_term():
    rng = np.random.default_rng(6)
    terms = [("a",), ("b",), ("a", "b"), ("b", "b", "c"), ("c", "a"), ("d",)]
    own = search._Phrases(terms)
    text = [[rng.choice(list("abcdx")) for _ in range(rng.integers(0, 30))] for _ in range(50)]
    rows = [(d, i, own.term[t]) for d, x in enumerate(text) for i, t in enumerate(x) if t != "x"]
    keys, n = own.counted(*np.array(rows, np.int64).T)
    want = Counter(d * len(terms) + p for d, x in enumerate(text) for i in range(len(x)) for p, t in enumerate(terms) if tuple(x[i : i + len(t)]) == t)
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want
    single = search._Phrases([("a",), ("b",)])
    single.keys = None  # no look at longer phrases
    assert [x.tolist() for x in single.counted(np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([1, 1, 0]))] == [[1, 2], [2, 1]]


def test_parts_of_questions_look_at_each_word_once(spark):
    rows = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n)) + "  ") for n in range(40)] + [(50, " \n"), (51, None)], "qid long, question string")
    parts = search_queries.thirds(rows)
    want = [(n * 10 + s, " ".join(f"w{i}" for i in range(n) if i * 3 // n == s)) for n in range(40) for s in range(3)]
    assert sorted(map(tuple, parts.collect())) == [x for x in want if x[1]]
    assert "lambdafunction" not in plan(parts)


def test_questions_are_cut_into_words_by_all_cores_and_a_pool_is_made_once(spark, folder):
    asked = search_queries.questions(spark, folder)
    assert asked.count() and asked.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "count(1)" not in plan(search_queries._evidence_of(spark, folder))
