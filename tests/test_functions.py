from pyspark.sql import functions as F

from landloom.functions import geo, normalize
from landloom.operators import upserts


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_owner_name(spark):
    assert one(spark, normalize.owner_name(F.lit(" Smith & Sons, LLC  et al "))) == "SMITH AND SONS"
    assert one(spark, normalize.owner_name(F.lit(None).cast("string"))) == ""


def test_owner_address(spark):
    a = one(spark, normalize.owner_address(F.lit("12 North Oak Street, Atlanta GA, GA 30301-1234")))
    assert (a["house"], a["street"], a["street_relaxed"], a["city"], a["zip5"]) == ("12", "N OAK ST", "OAK ST", "ATLANTA", "30301")
    assert a["strict_key"] == "12|N OAK ST|ATLANTA|30301" and not a["is_po_box"]
    b = one(spark, normalize.owner_address(F.lit("PO BOX 7, Macon, GA 31201")))
    assert b["is_po_box"] and b["po_box"] == "7"
    assert one(spark, normalize.owner_address(F.lit(", GA")))["strict_key"] == "|||"
    assert one(spark, normalize.owner_address(F.lit("  ")))["strict_key"] == ""


def test_amounts_and_codes(spark):
    for text, value in (("$1,234.56", 1234.56), ("(12.00)", -12.0), ("n/a", 0.0), (None, 0.0)):
        assert one(spark, normalize.money(F.lit(text).cast("string"))) == value
    for text, value in (("30301-1234", "30301"), ("30301", "30301"), ("123", ""), (None, "")):
        assert one(spark, normalize.zip5(F.lit(text).cast("string"))) == value
    assert one(spark, normalize.preferred_flag(F.lit(" Yes "))) and not one(spark, normalize.preferred_flag(F.lit("0")))


def test_ratios_count_repeats(spark):
    assert one(spark, normalize.subset_ratio(F.lit("A A B"), F.lit("A C"))) == 2 / 3
    assert one(spark, normalize.overlap_ratio(F.lit("A B"), F.lit("A C D"))) == 1 / 3


def test_polygons(spark):
    shape = geo.square(F.lit(10.0), F.lit(20.0), F.lit(4.0))
    assert one(spark, geo.area(shape)) == 16
    assert one(spark, geo.centroid(shape[0][0])).asDict() == {"x": 12.0, "y": 22.0}
    for x, y, inside in ((10.0, 20.0, True), (12.0, 24.0, True), (12.0, 22.0, True), (9.9, 22.0, False), (14.0, 25.0, False)):
        assert one(spark, geo.covers(shape[0][0], F.lit(x), F.lit(y))) is inside


def test_upserts(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 2, "d")], "k int, seq int, v string")
    assert sorted(r["v"] for r in upserts.last_write_wins(rows, ["k"], "seq").collect()) == ["b", "c", "d"]
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", ""), (3, "C", "Z")], "k int, v string, w string")
    assert sorted(map(tuple, upserts.upsert_columns(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]
    assert sorted(map(tuple, upserts.update_non_empty(old, new, ["k"], ["v", "w"]).collect())) == [(1, "a", "x"), (2, "B", "y")]
    assert sorted(map(tuple, upserts.insert_ignore(old, new, ["k"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "C", "Z")]


def test_progress_stream_equals_batch(spark, tmp_path):
    from landloom.plans.activity import st5_progress

    folder = "/root/testdata/sf0.001/events.parquet"
    stamped = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    raw = spark.read.parquet(folder)
    batch = stamped(raw)
    stream = stamped(spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")).withWatermark("ts", "1 hour")
    query = st5_progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, st5_progress(batch).collect()))
