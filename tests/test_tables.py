from lodestone.sources import tables


def test_each_key_once_without_moving_rows(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(100)] + [(i, f"again {i}") for i in range(0, 100, 10)] + [(None, "none")]
    spark.createDataFrame(rows, "chunk_id long, text string").repartition(3).write.parquet(f"{tmp_path}/chunks.parquet")
    for few in (100_000, 2):
        made = tables.once(spark, str(tmp_path), "chunks", "chunk_id", ["chunk_id", "text"], few)
        assert sorted(r["chunk_id"] for r in made.collect()) == list(range(100)) and made.columns == ["chunk_id", "text"]
        assert few == 2 or "Exchange hashpartitioning" not in made._jdf.queryExecution().toString()
