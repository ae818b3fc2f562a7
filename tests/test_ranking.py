"""Ranks and running totals against a plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from landloom.operators.ranking import exact_percentiles, keyset_bounds, paged, ranked, running_totals


@pytest.mark.parametrize("groups", [1, 7, 400])
def test_running_totals(spark, groups):
    rows = spark.range(3000).select(F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(groups))).alias("g"), F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**9))).alias("t"), "id")
    got = {r.id: (r.nth, r.s) for r in running_totals(rows, ["g"], ["t", "id"], {"nth": F.lit(1), "s": F.col("id") * 2}).collect()}
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first(), "id")
    want = {r.id: (r.n, r.s) for r in rows.withColumn("n", F.row_number().over(w)).withColumn("s", F.sum(F.col("id") * 2).over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()}
    assert got == want


def test_no_rows_and_equal_rows(spark):
    rows = spark.createDataFrame([(1, 5)] * 4, "g long, t long")
    assert sorted(r.nth for r in ranked(rows, ["g"], ["t"]).collect()) == [1, 2, 3, 4]
    assert ranked(rows.where("g > 1"), ["g"], ["t"]).collect() == []


def test_percentiles_and_pages(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("g"), F.when(F.col("id") % 5 > 0, F.round(F.rand(3) * 50, 1)).alias("v"), "id")
    rows = rows.unionByName(spark.createDataFrame([(99, 2.5, 5000)], "g long, v double, id long"))
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    want = {r.g: r.p for r in rows.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    got = {r.g: r.p for r in exact_percentiles(rows, ["g"], "v", shares).collect()}
    assert got.keys() == want.keys() and None in got and all(abs(a - b) < 1e-9 for g in want for a, b in zip(got[g], want[g], strict=True))
    whole = exact_percentiles(rows, [], "v", [0.5]).collect()
    assert len(whole) == 1 and exact_percentiles(rows.where("v > 99"), ["g"], "v", shares).collect() == []
    held = sorted((r.id, r.g) for r in rows.where("g = 3").collect())
    pages = paged(rows.where("g IS NOT NULL"), ["g"], ["id"], 25).where("g = 3 AND page = 4").orderBy("nth").collect()
    assert [r.id for r in pages] == [i for i, _ in held[75:100]] and pages[0].pages == -(-len(held) // 25)
    bounds = keyset_bounds(rows.where("id < 2000"), "id", 300).orderBy("page").collect()
    assert [(r.page, r.first_key, r.last_key, r.n) for r in bounds][-1] == (7, 1800, 1999, 200) and len(bounds) == 7
