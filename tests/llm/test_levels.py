from lodestone.llm import levels


def test_held_out_samples(spark, folder):
    samples = spark.read.parquet(f"{folder}/level_samples.parquet")
    right = total = 0
    for fold in range(4):
        docs = samples.where(f"sample_id % 4 = {fold}").selectExpr("sample_id AS doc_id", "text", "length(text) AS n_chars", "'zz' AS lang", "level AS grade")
        truth = {r["doc_id"]: r["grade"] for r in docs.collect()}
        got = {r["doc_id"]: r["level"] for r in levels.levels(docs, samples.where(f"sample_id % 4 <> {fold}")).collect()}
        right += sum(got.get(i) == v for i, v in truth.items())
        total += len(truth)
    assert right / total > 0.93, (right, total)


def test_syllables():
    for word, lang, n in (("make", "en", 1), ("table", "en", 2), ("organisation", "en", 5), ("walked", "en", 1), ("straße", "de", 2), ("bauern", "de", 2), ("histoire", "fr", 2), ("canción", "es", 2), ("leer", "es", 2), ("x", "en", 1), ("wanted", "en", 2), ("houses", "en", 2), ("makes", "en", 1), ("idea", "en", 3), ("special", "en", 2), ("confidentiality", "en", 7), ("studying", "en", 3), ("little", "en", 2), ("documentation", "fr", 5), ("parlent", "fr", 1), ("ciudad", "es", 2), ("guerra", "es", 2)):
        assert levels.syllables(word, lang) == n, (word, levels.syllables(word, lang))


def test_edges(spark, folder):
    samples = spark.read.parquet(f"{folder}/level_samples.parquet")
    rows = [(1, None, 500), (2, "", 500), (3, "123 456 !!!", 500), (4, "The cat sat. " * 40, 520), (4, "The cat sat. " * 40, 520), (5, "The cat sat. " * 40, None), (6, "The cat sat. " * 40, 399), (7, "word " * 100_000, 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = [(r["doc_id"], r["level"]) for r in levels.levels(docs, samples).collect()]
    assert sorted(i for i, _ in got) == [4, 4, 7] and ("basic" in {v for i, v in got if i == 4})
    assert levels.levels(docs.limit(0), samples).count() == 0
    assert levels.levels(docs, samples.limit(0)).count() == 0


def test_long_sentences_count_in_full():
    grades = [levels.grade(" ".join(["the committee reviewed the garden of a neighbour"] * n) + ".")[1] for n in (2, 3, 4, 5, 8, 12)]  # up to 96 words
    assert grades == sorted(set(grades)), grades
    bare = levels.grade(" ".join(["the committee reviewed the garden of a neighbour"] * 40))[1]  # text without marks
    assert grades[0] - 1 <= bare <= grades[1], (bare, grades)
    listed = levels.grade("\n".join(["warm bread", "cold milk", "two apples", "fresh fish"] * 9))[1]
    assert listed < levels.grade(" ".join(["warm bread", "cold milk", "two apples", "fresh fish"] * 9))[1]
