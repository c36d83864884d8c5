import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mix


@pytest.fixture
def made(spark):
    rows = [(i, "big", "word " * (5 + i % 7)) for i in range(400)] + [(1000 + i, "small", "tiny text") for i in range(10)] + [(2000, "none", None), (2001, None, "x"), (2002, "unlisted", "x y z"), (None, "big", "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 3), ("small", 0.01, 8), ("none", 0.2, 2), ("gone", 0.2, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_plan_copies_and_shares(spark, made):
    used, plan = mix.mix(*made)
    rows, by = used.collect(), {r["source"]: r for r in plan.collect()}
    assert set(by) == {"big", "small", "none", "gone"}
    assert [by[s]["short"] for s in ("big", "small", "none", "gone")] == [False, False, True, True]
    total = sum(r["tokens"] for r in rows)
    for source, most in (("big", 3), ("small", 8)):
        own = [r for r in rows if r["source"] == source]
        assert max(r["copies"] for r in own) <= most
        want = by[source]["target_share"] * total
        assert abs(sum(r["tokens"] * r["copies"] for r in own) - want) <= max(r["tokens"] for r in own)


def test_same_choices_again_and_in_a_tree(spark, made, monkeypatch):
    monkeypatch.setattr(mix, "LEAF", 7)
    monkeypatch.setattr(mix, "FAN", 3)
    first = sorted(map(tuple, mix.mix(*made)[0].collect()), key=repr)
    assert first == sorted(map(tuple, mix.mix(made[0].repartition(5), made[1])[0].collect()), key=repr)
    big = [r for r in first if r[1] == "big"]
    total = sum(r[2] for r in first)
    assert abs(sum(r[2] * r[3] for r in big) - 0.5 * total) <= 20


def test_fractions_keep_their_mean():
    import pandas as pd

    hits, rng = 0, np.random.default_rng(0)
    for _ in range(1000):
        rows = pd.DataFrame({"doc_id": range(5), "tokens": [3, 1, 4, 1, 5], "part": [0.3] * 5, "draw": rng.random(5)})
        made = mix._pivot(rows)
        assert abs((made["part"] * made["tokens"]).sum() - 0.3 * 14) < 1e-6
        assert ((made["part"] > 0) & (made["part"] < 1)).sum() <= 1
        hits += made["part"][2]
    assert 0.25 < hits / 1000 < 0.35


def test_empty_tables(spark, made):
    docs, targets = made
    report = mix.shares(docs.limit(0), targets).collect()
    assert len(report) == 4 and all(r["mixed"] == 0 for r in report)
    assert mix.shares(docs, targets.limit(0)).count() == 0
    assert mix.shares(*made).where("short").select("source").count() == 2


def test_shares_of_the_real_sources(spark):
    """Each source misses its share by less than one document, none is used too often, short ones are used up."""
    folder = "/root/testdata/sf0.01"
    docs, targets = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/source_targets.parquet")
    used, plan = mix.mix(docs, targets)
    rows = used.collect()
    total = sum(r["tokens"] for r in rows)
    for p in plan.collect():
        own = [r for r in rows if r["source"] == p["source"]]
        got, most = sum(r["tokens"] * r["copies"] for r in own), max((r["copies"] for r in own), default=0)
        assert most <= p["max_repeats"]
        if p["short"]:
            assert got == p["max_repeats"] * sum(r["tokens"] for r in own)
        else:
            assert abs(got - p["target_share"] * total) <= max(r["tokens"] for r in own), p
