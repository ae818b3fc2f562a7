"""The request log's sizes beyond a megabyte."""

import duckdb
from pyspark.sql import functions as F

from landloom.functions.normalize import size_text
from landloom.plans.activity import ORACLES, agg14_request_log


def test_sizes_as_the_sql_tells_them(spark, tmp_path):
    rows = [(i, 1 + i % 3, f"k{i % 3}", 900_000.0 + i) for i in range(9)]
    made = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double")
    made.withColumn("ts", F.timestamp_seconds(F.col("s")).cast("timestamp_ntz")).drop("s").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(c.execute(f"SELECT category, size FROM ({ORACLES['agg14_request_log']})").fetchall())
    got = {r["category"]: r["size"] for r in agg14_request_log(spark, f"file://{tmp_path}").collect()}
    assert got == want and all(v.endswith(" KB") and float(v[:-3]) > 1024 for v in got.values())


def test_sizes_are_the_nearest(spark):
    told = [spark.range(1).select(size_text(F.lit(n), "KB").alias("s")).first()["s"] for n in (1000.7, 2.5, 1280.0, 5.0 * 1024**2)]
    assert told == ["1001 B", "2 B", "1.2 KB", "5120.0 KB"]
