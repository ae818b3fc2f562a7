"""Stored tiles: keys, upserts of ranges, pruned lookups, outcomes."""

import os

import pyspark.sql.functions as F
import pytest

from landloom.operators import tile_store
from landloom.operators.tile_store import lookup_tiles, tile_key, upsert_tiles

SCHEMA = "layer string, z int, x int, y int, feature_count long, payload string"


@pytest.fixture
def path(tmp_path, monkeypatch):
    monkeypatch.setattr(tile_store, "RANGE_LEVELS", 2)  # sixteen tiles a range
    return f"file://{tmp_path}/tiles"


def tiles(spark, z, n, payload="old", **counts):
    return spark.createDataFrame([("a", z, x, y, counts.get(f"t{x}_{y}", 1), f"{payload} {x} {y}") for x in range(n) for y in range(n)], SCHEMA)


def files(path):
    folder = path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_keys_follow_the_bits(spark):
    for x, y in ((0, 0), (1, 0), (0, 1), (5, 9), (524_287, 1), (2**24 - 1, 2**24 - 1)):
        want = sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(24))
        assert spark.range(1).select(tile_key(F.lit(x), F.lit(y)).alias("k")).first()["k"] == want


def test_second_write_touches_its_ranges_only(spark, path):
    assert upsert_tiles(tiles(spark, 5, 16), path) == {5: {"stored": 256, "empty": 0}}
    before = files(path)
    part = tiles(spark, 5, 4, "new", t0_0=0, t3_3=0).where("x < 4 AND y < 4")
    assert upsert_tiles(part, path, [5]) == {5: {"stored": 14, "empty": 2}}
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert all(("range=0/" in f) != (f in same) for f in before) and len({os.path.dirname(f) for f in after}) == 16
    stored = {(r.x, r.y): r.payload for r in spark.read.parquet(path).collect()}
    assert len(stored) == 254 and (0, 0) not in stored and stored[1, 1] == "new 1 1" and stored[4, 1] == "old 4 1"
    gone = tiles(spark, 5, 4).withColumn("feature_count", F.lit(0).cast("long"))
    assert upsert_tiles(gone, path, [5]) == {5: {"stored": 0, "empty": 16}} and spark.read.parquet(path).count() == 240
    more = tiles(spark, 5, 4, "again").withColumn("layer", F.lit("b"))
    upsert_tiles(more, path)
    assert {r[0]: r[1] for r in spark.read.parquet(path).groupBy("layer").count().collect()} == {"a": 240, "b": 16}


def test_lookups_read_the_asked_ranges(spark, path, monkeypatch):
    upsert_tiles(tiles(spark, 6, 32), path)
    asked = spark.createDataFrame([("a", 6, 1, 2), ("a", 6, 30, 31), ("a", 6, 60, 60), ("none", 6, 1, 2)], "layer string, z int, x int, y int")
    got = lookup_tiles(spark, path, asked)
    assert {(r.layer, r.x, r.y): r.payload for r in got.collect()} == {("a", 1, 2): "old 1 2", ("a", 30, 31): "old 30 31", ("a", 60, 60): None, ("none", 1, 2): None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [IsNotNull(key)" in plan
    one = lookup_tiles(spark, path, asked.limit(1))
    read = one._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in read and len(files(path)) >= 64
    scanned = spark.read.parquet(path).where("layer = 'a' AND z = 6 AND range = 0").select(F.input_file_name()).distinct().count()
    assert scanned <= 2
    monkeypatch.setattr(tile_store, "NAMED_RANGES", 0)
    assert sorted(map(str, lookup_tiles(spark, path, asked).collect())) == sorted(map(str, got.collect()))
    assert lookup_tiles(spark, path, asked.limit(0)).collect() == []
