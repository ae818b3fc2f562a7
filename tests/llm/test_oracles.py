import pytest
from pyspark.sql import functions as F

from landloom.llm import decontamination, languages, mixing, registry, secrets, url_filters
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    assert same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_targets_fill_up_to_the_cap(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 100)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals, mixing.WEIGHTS, 1.5).collect()}
    assert got == {"a": 200.0, "c": 200.0, "b": 1400.0}


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, 10 + i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()))
    taken, target = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/x?q"), (4, "a://b.net/es"), (5, "a://b.net/es/"), (6, "http://com"), (7, "http://com/"), (7, "http://com/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [(r["page_id"], r["host"], r["path"], r["best"] and r["best"]["name"]) for r in url_filters.filter_urls(df, url_filters.BASE_RULES).orderBy("page_id").collect()]
    assert got == [(1, "", "", None), (2, "", "", None), (3, "www.example.com", "/en/x", "www.example.com/en/"), (4, "b.net", "/es", None), (5, "b.net", "/es/", "net/es/"), (6, "com", "", None), (7, "com", "/", "com/"), (7, "com", "/", "com/")]


def test_url_index_as_table_agrees(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rules = url_filters.BASE_RULES + url_filters.METHOD_RULES
    literal = sorted(map(str, url_filters.filter_urls(df, rules).collect()))
    monkeypatch.setattr(url_filters, "MAX_LITERAL_RULES", 0)
    assert sorted(map(str, url_filters.filter_urls(df, rules).collect())) == literal


def test_trigram_queries_lose_no_match(spark):
    found = ["gho_" + "a1B2" * 10, "xoxb-" + "1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "rk_live_" + "x" * 24, "eyJhbGciOiJI.eyJzdWIiOiIx", "API-KEY", "ApiKey = 'abcdefgh'", "PASSWD:secretpw", "AKIA" + "Q" * 16, "0f" * 12, "0F" * 16]
    df = spark.createDataFrame([(i, f"é {t} .") for i, t in enumerate(found)], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in secrets.scan_secrets(df).collect()}
    assert [got[i][:1] for i in range(len(found))] == [["github"], ["slack"], ["private_key"], ["live_key"], ["jwt"], [], ["assign"], ["assign"], ["access"], ["hex"], ["upper_hex"]]


def test_leaks_planted(spark):
    item = " ".join(f"q{i}" for i in range(30))
    edited = item.replace("q29", "zz")
    docs = [(1, f"some words before {item.upper()} and after"), (2, edited), (3, " ".join(f"q{i}" for i in range(12))), (4, None), (5, "hello world")]
    bench = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "hello world")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert got == [(1, 9), (2, 9), (5, 12)]


def test_languages_without_letters(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "12 !?", "en"), (4, None, "de"), (5, "und der hund", None)], "doc_id long, text string, lang string")
    langs, prototypes = languages.learn_prototypes(df)
    got = {r["doc_id"]: r["lang_pred"] for r in languages.predict_languages(df, langs, prototypes).collect()}
    assert langs == ["de", "en"] and got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "de"}


def test_mix_meets_the_target_of_a_source_of_few_short_documents(spark):
    rows = [(i, "tiny" if i % 2000 == 7 else "thin" if i % 400 == 9 else f"s{i % 3}", 5 if i % 2000 == 7 else 180 if i % 400 == 9 else 20 + i % 90) for i in range(20_000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    sums = {r["source"]: (r["taken"], r["target"]) for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert sums["tiny"][1] == 100 and all(abs(taken - target) <= 1 for taken, target in sums.values()), sums
