"""Parcel tiles: heavy work on a narrow table is dealt to many tasks, and a shape is clipped once."""

import pyspark.sql.functions as F

from landloom.functions.geo import bbox, clipped
from landloom.plans.tiles import _with_shape, parcel_features, q16_tax_parcel_tiles, tile_rows, tiles_touched
from landloom.sources.tables import lots, parcels
from tests.oracle import DATA


def test_one_file_is_dealt_to_many_tasks(spark):
    for rows in (parcels(spark, f"{DATA}/sf0.001"), lots(spark, f"{DATA}/sf0.001")):
        assert rows.rdd.getNumPartitions() >= 4


def test_shapes_are_clipped_once(spark):
    for tiles in (tile_rows(parcel_features(spark, f"{DATA}/sf0.001")), q16_tax_parcel_tiles(spark, f"{DATA}/sf0.001")):
        plan = tiles._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "lambda" in line]


def test_shapes_within_a_tile_are_not_cut(spark):
    """with its box a shape is clipped to the same points as without, be it within the tile's reach, across it, with a hole, or of too few points."""
    ring = lambda x0, y0, x1, y1, n=5: [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))[:n]]
    shapes = [[[ring(10, 10, 40, 50)]], [[ring(-3000, -90, 2400, 70)]], [[ring(100, 100, 900, 900), ring(300, 300, 600, 600), ring(400, 400, 401, 401)]], [[ring(5, 5, 9, 9, 3)]], [[ring(10, 10, 20, 20, 2)], [ring(2000, 2000, 2600, 2600)]], []]
    rows = spark.createDataFrame(list(enumerate(shapes)), "id int, geom array<array<array<struct<x:double,y:double>>>>").withColumn("bbox", bbox(F.col("geom")))
    tiles = tiles_touched(rows.where("id < 5"), (13, 14, 16)).unionByName(rows.where("id = 5").selectExpr("*", "14 AS z", "8192 AS x", "8191 AS y"))
    for pixels in (0, 16, 256):
        at = [F.col(c) for c in ("geom", "z", "x", "y")]
        told = tiles.select("id", clipped(*at, F.lit(pixels)).alias("plain"), clipped(*at, F.lit(pixels), box=F.col("bbox")).alias("boxed")).collect()
        assert len(told) > 20 and all(r.plain == r.boxed for r in told) and any(r.plain for r in told)
        assert _with_shape(tiles, F.lit(pixels)).count() == sum(r.plain is not None for r in told)
