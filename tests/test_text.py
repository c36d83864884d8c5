from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.settings import Settings, load_settings


def column(spark, values, made):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", made(F.col("t")).alias("x")).orderBy("i").collect()]


def test_terms_and_tokens(spark):
    assert column(spark, ["CAFÉ foo_bar x 3.14", None, ""], X.index_terms) == [["cafe", "foo", "bar", "x", "3", "14"], None, []]
    assert column(spark, ["A CAFÉ café foo_bar x", None], X.query_tokens) == [["café", "foo_bar"], None]


def test_token_estimate(spark):
    assert column(spark, ["", "abc", "a" * 8, "é😀" * 6], X.approx_tokens) == [1, 1, 2, 3]


def test_gate(spark):
    many = ["compare the two contracts we signed in march and say which is cheaper"]
    assert column(spark, ["short and sweet", *many, "what is due next week? and who pays for it? " * 2, "one two three four five six seven eight nine", "please answer 1) the rent is due when exactly here", "w " * 31, None], X.needs_parts) == [False, True, True, False, True, True, None]


def test_citation_marks(spark):
    assert column(spark, ["[2] x [1] [2] [9] [0] [99999999999]", "none", None], lambda t: X.citation_marks(t, F.lit(3))) == [[1, 2], [], None]


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "s.toml"
    f.write_text('vector_top_k = 3\nunknown = 1\nconjunctions = [" or "]\n')
    monkeypatch.delenv("LODESTONE_DIR", raising=False)
    assert load_settings(str(f)) == Settings(vector_top_k=3, conjunctions=(" or ",))
    monkeypatch.setenv("LODESTONE_DIR", "/x")
    assert load_settings(None).data_dir == "/x"
