import random

import corpus_pipeline as P
from tests.llm.test_near_duplicates import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    rng = random.Random(4)
    x, y, z = (" ".join(words(rng, 120)) for _ in range(3))
    rows = [(5, x, "a"), (5, y, "a"), (5, y, "b"), (7, x + " more", "a"), (None, z, "b"), (None, z, "a"), (None, y + " more", "a"), (9, "", "a")]
    got = sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in P.keep_one_of_each_class(spark, table(spark, rows), "").collect())
    assert got == sorted([(5, x, "a"), (5, y, "a"), (0, z, "a"), (9, "", "a")])


def test_leaks_are_dropped_row_by_row(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {item} after", "a"), (3, f"before {item} after", "a"), (3, "a clean text of the same id", "a"), (None, "a clean text without one", "a"), (4, None, "a")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    got = {(r["doc_id"], r["text"]) for r in P.drop_leaks(spark, df, str(tmp_path)).collect()}
    assert got == {(i, t) for i, t, _ in rows[2:]}


def test_mix_takes_rows_of_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i // 2, f"text number {i} of all", "ab"[i % 2]) for i in range(600)]
    got = P.mix(spark, table(spark, rows), "").collect()
    again = P.mix(spark, table(spark, rows).repartition(5), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len({r["text"] for r in got}) == len(got) and any(r["doc_id"] is None for r in got)
    for s in "ab":
        of = [r for r in got if r["source"] == s]
        assert all(0 < r["taken"] <= 2 * r["size"] for r in of) and abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 1


def test_languages_without_letters_are_rejected(spark):
    rows = [(1, "the cat and the dog", "a"), (2, "1234 !!", "a"), (3, None, "a"), (4, "", "a"), (None, "the dog and the cat", "a")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    assert sorted(((r["doc_id"] or 0) for r in P.keep_known_languages(spark, df, "").collect())) == [0, 1]
    unlabelled = df.withColumn("lang", P.F.lit(None).cast("string"))
    assert P.keep_known_languages(spark, unlabelled, "").count() == 5


def test_secrets_are_redacted_row_by_row(spark):
    rows = [(1, "my password: abcdef12 end", "a"), (1, "clean text", "a"), (None, "token = abcdefgh", "a"), (2, None, "a")]
    df = spark.createDataFrame([(i, t, "en", s, 99) for i, t, s in rows], SCHEMA).withColumn("secrets", P.F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in P.redact_secrets(spark, df, "").collect()), key=str)
    assert got == sorted([(1, "my [assign] end", 15), (1, "clean text", 99), (0, "[assign]", 8), (2, None, 99)], key=str)


def test_whole_run_against_what_was_planted(spark, tmp_path):
    """Every stage's decision on 60 clean documents and planted ones; then an empty corpus."""
    rng = random.Random(9)
    clean = [(i, " ".join(words(rng, 60)), "ab"[i % 2]) for i in range(60)]
    item = " ".join(f"q{i}" for i in range(30))
    copy = clean[0][1] + " tail"
    rows = [*clean, (100, copy, "a"), (101, clean[1][1].upper(), "b"), (102, " ".join(words(rng, 20)) + " " + item, "a"), (103, "12 34 !!", "a"), (104, " ".join(words(rng, 40)) + " password = hunter22x", "b"), (105, None, "a")]
    folder = str(tmp_path / "one")
    table(spark, [(i, t or "", s) for i, t, s in rows]).withColumn("text", P.F.when(P.F.col("doc_id") != 105, P.F.col("text"))).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in P.run(spark, folder).collect()}
    assert set(got) == {*range(60), 104}
    assert got[104]["text"].endswith("[assign]") and all(got[i]["text"] == t for i, t, _ in clean)
    for s in "ab":
        own = [r for r in got.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 2 * r["size"] for r in own)
    empty = str(tmp_path / "none")
    table(spark, rows[:1]).limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, empty).count() == 0
