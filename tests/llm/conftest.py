import pytest

CHUNK = "chunk_id long, doc_id long, chunk_idx int, text string, char_start int, char_end int, page int, embedding array<float>"


@pytest.fixture
def chunks(spark):
    """Makes a chunks table of (chunk_id, text) or longer rows, with columns whose names clash with the operators' own."""

    def make(rows, **extra):
        full = [(*r, *[None] * (8 - len(r))) if len(r) > 2 else (r[0], 1, 0, r[1], 0, len(r[1] or ""), extra.get("page"), extra.get("embedding")) for r in rows]
        df = spark.createDataFrame(full, CHUNK)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("clash") for c in ("id", "found", "band", "cell", "kind", "piece", "tokens", "part", "a", "b", "_text", "rank")})

    return make
