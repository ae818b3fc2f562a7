"""Scoped resets of owner groups, and upserts with null and repeated keys."""

import os

import pyspark.sql.functions as F

from landloom.operators import upserts
from landloom.operators.group_tables import GroupTables


def stamps(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_reset_of_one_county(spark, tmp_path):
    tables = GroupTables(spark, f"file://{tmp_path}/t")
    members = spark.range(3000).select(F.concat(F.lit("g"), (F.col("id") % 700).cast("string")).alias("group_key"), F.col("id").alias("parcel_id"), F.when(F.col("id") % 700 < 5, 3).otherwise(F.col("id") % 6).cast("int").alias("county_id"))
    groups = members.select("group_key").distinct().withColumn("kind", F.lit("name"))
    tables.write(members, groups)
    before = stamps(f"{tmp_path}/t")
    tables.reset(3)
    after = stamps(f"{tmp_path}/t")
    want = {r.group_key for r in members.where("county_id <> 3").select("group_key").distinct().collect()}
    assert {r.group_key for r in tables.groups().collect()} == want and tables.members().where("county_id = 3").count() == 0 and len(want) < 700
    changed = {f for f in before if after.get(f) != before[f]}
    assert all("county_id=3/" in f or "/groups/bucket=" in f for f in changed)
    buckets = {r[0] for r in members.where("id % 700 < 5").select(F.pmod(F.xxhash64("group_key"), F.lit(64))).distinct().collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in changed if "/groups/" in f} == buckets  # no other bucket was written
    tables.reset(77)  # a county without members
    assert stamps(f"{tmp_path}/t") == after
    tables.write(members.where("county_id = 3"), groups.where("group_key IN ('g0', 'g1', 'g2', 'g3', 'g4')"))  # built anew
    assert tables.members().count() == 3000 and tables.groups().count() == 700
    tables.reset()
    assert stamps(f"{tmp_path}/t") == {}


def test_upserts_with_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", "x", "t0"), (2, "b", "y", "t0"), (None, "n", "z", "t0")], "k long, v string, w string, seen string")
    new = spark.createDataFrame([(1, "A", "", 1), (1, "", "X", 2), (1, "AA", None, 3), (2, "", None, 1), (None, "q", "q", 1)], "k long, v string, w string, at long")
    got = upserts.update_non_empty(old, new, ["k"], ["v", "w"], "at", ("seen", F.lit("t1")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "AA", "X", "t1"), (2, "b", "y", "t0"), (None, "n", "z", "t0")]))
    rows = spark.createDataFrame([(3, "late", 2), (3, "early", 1), (None, "p", 1), (None, "p", 1), (1, "no", 1)], "k long, v string, at long")
    put = upserts.insert_ignore(old.select("k", "v", F.lit(0).cast("long").alias("at")), rows, ["k"], ["at"])
    assert sorted(str((r.k, r.v)) for r in put.collect()) == sorted(map(str, [(1, "a"), (2, "b"), (None, "n"), (3, "early"), (None, "p"), (None, "p")]))
    last = upserts.last_write_wins(rows, ["k"], "at")
    assert sorted(str((r.k, r.v)) for r in last.collect()) == sorted(map(str, [(3, "late"), (None, "p"), (None, "p"), (1, "no")]))
    assert last._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # what feeds it runs once
