"""Answering of all turns."""

import numpy as np
import pytest

from lodestone.operators import context, search
from lodestone.plans import registry


def asked(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversation_turns.parquet").where("content is not null and turn_id is not null")
    return sorted(r["turn_id"] for r in turns.select("turn_id").distinct().collect())


@pytest.mark.parametrize("name", ["answer_by_parts", "answer_one_pass"])
def test_every_turn_is_answered_once(spark, folder, name):
    rows = registry.QUERIES[name](spark, folder).collect()
    assert sorted(r["qid"] for r in rows) == asked(spark, folder)
    assert all((r["answer"] == "NOT_FOUND") == (not r["sources"]) for r in rows)


def test_many_queries_meet_a_part_of_the_vectors_ahead(spark, monkeypatch):
    x = np.random.default_rng(0).standard_normal((400, 6)).round(1)  # with ties
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>").repartition(5).cache()
    asked = vectors.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "qid")
    want = sorted(map(tuple, search.cosine(vectors, asked, 4).collect()))
    monkeypatch.setattr(search, "MANY", 1)
    assert sorted(map(tuple, search.cosine(vectors, asked, 4).collect())) == want
    n = x / np.linalg.norm(x, axis=1)[:, None]
    score, own = np.full((50, 4), -np.inf), np.zeros((50, 4), np.int64)
    floors = np.sort(np.round(n[:50] @ n[::8].T, 6), axis=1)[:, -4]
    search._near(n[:50], n, np.arange(400), score, own, floors)
    assert all(own[q].tolist() == np.lexsort((np.arange(400), -np.round(n @ n[q], 6)))[:4].tolist() for q in range(50))


def test_chunks_are_packed_once_for_all_blocks_of_questions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 5}") for i in range(60)], "chunk_id long, text string")
    asked = spark.createDataFrame([(q, f"common word{q}") for q in range(9)], "qid long, question string")
    want, calls, of_texts = sorted(map(tuple, search.bm25(docs, asked).collect())), [], search._of_texts
    monkeypatch.setattr(search, "_of_texts", lambda *a: calls.append(1) or of_texts(*a))
    monkeypatch.setattr(search, "ASKED", 4)
    assert sorted(map(tuple, search.bm25(docs, asked).collect())) == want and len(calls) == 1
    monkeypatch.setattr(search, "PHRASES", 3)
    assert sorted(map(tuple, search.bm25(docs, asked).collect())) == want and len(calls) > 2


def test_packing_by_tokens_is_packing_by_texts(spark):
    rows = spark.createDataFrame([(q, p, "x" * (97 * p * q)) for q in range(1, 6) for p in range(1, 8)], "qid long, place long, text string")
    short = rows.selectExpr("qid", "place", "cast(greatest(1, floor(length(text) / 4)) as long) AS tokens")
    packed = [sorted((r["qid"], r["place"], r["spent"]) for r in context.pack(x, 200).collect()) for x in (rows, short)]
    assert packed[0] == packed[1] and len(packed[0]) < 35
