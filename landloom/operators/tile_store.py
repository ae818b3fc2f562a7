"""Stored tiles: a Parquet table by layer, zoom and range of a space-filling key, of which writes replace and lookups read only the ranges they touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from landloom.operators.staging import staged

#: Levels of the quadtree below a range: it holds up to 4^RANGE_LEVELS tiles.
RANGE_LEVELS = 10
#: Ranges of a lookup or an upsert that are named in the scan's filter; more are left to Spark's pruning at run time.
NAMED_RANGES = 500
#: Masks that spread the bits of a number of up to 24 bits to every second place.
SPREADS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(v: Column) -> Column:
    v = v.cast("long")
    for shift, mask in SPREADS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def tile_key(x: Column, y: Column) -> Column:
    """The tile's place on the Z-order curve of its zoom: bits of x and y by turns."""
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def keyed(tiles: DataFrame) -> DataFrame:
    """tiles (z, x, y, ...) with key and range (the key of the tile RANGE_LEVELS zooms above)."""
    return tiles.withColumn("key", tile_key(F.col("x"), F.col("y"))).withColumn("range", F.shiftright("key", 2 * RANGE_LEVELS))


def _in_ranges(asked: DataFrame) -> Column | None:
    """Filter of the (layer, z, range) of asked rows, if they are few enough to be named."""
    rows = asked.select("layer", "z", "range").distinct().limit(NAMED_RANGES + 1).collect()
    if len(rows) > NAMED_RANGES:
        return None
    return reduce(lambda a, b: a | b, [(F.col("layer") == r["layer"]) & (F.col("z") == r["z"]) & (F.col("range") == r["range"]) for r in rows], F.lit(False))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, in any store that Spark reads; None where nothing is stored yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if exists else None


def remove_folder(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def upsert_tiles(tiles: DataFrame, path: str, zooms: list[int] | None = None) -> dict[int, dict[str, int]]:
    """Puts tiles (layer, z, x, y, feature_count, payload columns) into the table at `path`; a tile that is there is replaced. Tiles without features are not stored,
    and one that was is removed. Returns counts by zoom (stored, empty), taken in the writing pass by an observation.

    Rows are dealt to tasks by ranges of (layer, z, key), so a large layer or zoom is written by many tasks and files hold
    neighbouring keys, which their statistics tell. Old tiles of touched ranges are merged in and these directories alone are overwritten.
    tiles must hold a tile once; layer and z must not be null.
    """
    spark = tiles.sparkSession
    new = keyed(tiles)
    old = _stored(spark, path)
    seen = Observation(f"tiles-{id(tiles)}")
    asked = zooms if zooms is not None else sorted(r[0] for r in tiles.select("z").distinct().collect())
    full, empty = F.col("feature_count") > 0, F.coalesce(F.col("feature_count"), F.lit(0)) == 0
    counts = [F.count_if((F.col("z") == z) & which).alias(f"{name}_{z}") for z in asked for name, which in (("stored", full), ("empty", empty))]
    told = staged(new.observe(seen, *counts) if counts else new)
    rows = told.where(full)
    if old is not None:
        touched = _in_ranges(told)
        reached = old.where(touched) if touched is not None else old.join(told.select("layer", "z", "range").distinct(), ["layer", "z", "range"], "left_semi")
        kept = reached.join(told.select("layer", "z", "key"), ["layer", "z", "key"], "left_anti")
        rows = staged(rows.unionByName(kept.select(*rows.columns)))  # what is overwritten must not be read at that time
    order = ["layer", "z", "range", "key"]
    if old is not None:  # a range of which no tile is left has no row that would overwrite it
        left = rows.select("layer", "z", "range").distinct()
        for r in told.select("layer", "z", "range").distinct().join(left, ["layer", "z", "range"], "left_anti").collect():
            remove_folder(spark, f"{path}/layer={r['layer']}/z={r['z']}/range={r['range']}")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "z", "range").parquet(path)
    got = seen.get if counts else {}
    return {z: {name: got[f"{name}_{z}"] for name in ("stored", "empty")} for z in asked}


def lookup_tiles(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """asked (layer, z, x, y, distinct) with the stored columns, null where nothing is stored. The scan reads the asked ranges only, and of their files those whose keys fit."""
    keys = keyed(asked)
    named = _in_ranges(keys)
    table = spark.read.parquet(path)
    if named is not None:
        low, high = keys.agg(F.min("key"), F.max("key")).first()
        table = table.where(named & F.col("key").between(low or 0, high if high is not None else -1))
    return keys.join(table.drop("x", "y"), ["layer", "z", "range", "key"], "left").drop("range", "key")
