"""Heatmap pyramid, parcel tiles and tile covers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.geo import CELLS, WORLD, area, bbox, buffer_pixels, cell, centroid_of, clipped, lat_of, let, lng_of, meets_box, mercator_x, mercator_y, point_on_surface, preview_path, square, tile_envelope, tile_x, tile_y
from landloom.functions.normalize import feature_id, site_number
from landloom.operators.staging import shared_folder, staged
from landloom.operators.tile_store import lookup_tiles, upsert_tiles
from landloom.operators.topology import simplified_together
from landloom.plans.taxes import taxed_parcels
from landloom.sources.tables import counties, parcels, with_tables

FINEST, COARSEST = 16, 6
#: Degrees by which a preview may differ, and its decimals.
PREVIEW = (0.00001, 5)
PARCEL_ZOOMS = (13, 14, 15, 16, 17, 18, 19)


def heatmap_pyramid(points: DataFrame, finest: int = FINEST, coarsest: int = COARSEST) -> DataFrame:
    """z, ix, iy, tax_year, total, n of the cells of all zooms. points: mx, my (metres), tax_year, tax_amount.

    One aggregation at the finest zoom; a cell's index shifted right is that of the
    cell that holds it, so the coarser zooms are sums of what is left of it.
    """
    fine = points.groupBy(cell(F.col("mx"), finest).alias("ix"), cell(F.col("my"), finest).alias("iy"), "tax_year").agg(F.sum("tax_amount").alias("total"), F.count("*").alias("n"))
    levels = fine.withColumn("z", F.explode(F.sequence(F.lit(coarsest), F.lit(finest))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(finest) - F.col("z"))).cast("long").alias(c)
    return levels.groupBy("z", up("ix"), up("iy"), "tax_year").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def q15_tax_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean tax of the cells of every zoom and year, with the tile that each lies in."""
    cells = heatmap_pyramid(taxed_parcels(spark, sf_dir, True).select("mx", "my", "tax_year", "tax_amount"))
    half = F.pow(F.lit(2.0), F.col("z") - 1).cast("long")
    return cells.select("z", "tax_year", "ix", "iy", (F.floor(F.col("ix") / CELLS) + half).alias("x"), (half - 1 - F.floor(F.col("iy") / CELLS)).alias("y"), F.round(F.col("total") / F.col("n"), 6).alias("mean_tax"), "n")


def tiles_touched(features: DataFrame, zooms: tuple[int, ...]) -> DataFrame:
    """features (with bbox) and z, x, y of every tile that their box touches: an equi-key for tile joins. Features are read once for all zooms."""
    b = F.col("bbox")
    spans = F.array(*[F.struct(F.lit(z).alias("z"), tile_x(b["minx"], z).alias("x0"), tile_x(b["maxx"], z).alias("x1"), tile_y(b["maxy"], z).alias("y0"), tile_y(b["miny"], z).alias("y1")) for z in zooms])
    tiles = F.flatten(F.transform(spans, lambda s: F.flatten(F.transform(F.sequence(s["x0"], s["x1"]), lambda x: F.transform(F.sequence(s["y0"], s["y1"]), lambda y: F.struct(s["z"].alias("z"), x.alias("x"), y.alias("y")))))))
    return features.withColumn("_tile", F.explode(tiles)).select(*features.columns, "_tile.z", "_tile.x", "_tile.y")


def parcel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parcels(spark, sf_dir).where("processed IS NULL AND objectid IS NOT NULL")
    shape = square(F.col("mx"), F.col("my"), F.col("side"))
    number = site_number(F.coalesce("site_address", F.lit("")))
    return p.select(feature_id(F.col("county_id"), F.col("objectid")).alias("feature_id"), "id", "county_id", number.alias("site_number"), "mx", "my", "side", shape.alias("geom")).withColumn("bbox", bbox(F.col("geom")))


def _with_extent(rows: DataFrame, points: Column) -> DataFrame:
    """rows with px0, py0, px1, py1 of polygons, whose points are laid out once for all four."""

    def of(flat: Column) -> Column:
        low = lambda f: F.array_min(F.transform(flat, lambda p: p[f]))
        high = lambda f: F.array_max(F.transform(flat, lambda p: p[f]))
        return F.struct(low("x").alias("px0"), low("y").alias("py0"), high("x").alias("px1"), high("y").alias("py1"))

    return rows.withColumn("_extent", let(F.flatten(F.flatten(points)), of)).select(*rows.columns, "_extent.*")


def _with_shape(rows: DataFrame, pixels: Column) -> DataFrame:
    """rows (geom, bbox, z, x, y) with their shape clipped to the tile; those that leave none go. It comes out of a generator, so that the optimizer can't clip once for the filter and again for the row."""
    shape = clipped(F.col("geom"), F.col("z"), F.col("x"), F.col("y"), pixels, box=F.col("bbox"))
    return rows.withColumn("shape", F.explode(F.array_compact(F.array(shape))))


def tile_rows(features: DataFrame, zooms: tuple[int, ...] = PARCEL_ZOOMS) -> DataFrame:
    """z, x, y, features (id, shape clipped to the tile, whether the tile owns its label), feature_count, label_count of parcel tiles.

    A label stands at the feature's point on its surface; features without a site number have none.
    """
    on = point_on_surface(F.col("geom")[0][0])
    own = F.lit(False)
    for z in zooms:
        own = own | ((F.col("z") == z) & (F.col("x") == tile_x(F.col("label.x"), z)) & (F.col("y") == tile_y(F.col("label.y"), z)))
    labelled = features.withColumn("label", F.when(F.coalesce(F.col("site_number"), F.lit("")) != "", on))
    told = _with_shape(tiles_touched(labelled, zooms), buffer_pixels(F.col("z"))).select("z", "x", "y", F.struct("feature_id", "shape", F.coalesce(own, F.lit(False)).alias("owned")).alias("feature"))
    return told.groupBy("z", "x", "y").agg(F.sort_array(F.collect_list("feature")).alias("features"), F.count("*").alias("feature_count"), F.count_if("feature.owned").alias("label_count"))


def tile_summary(tiles: DataFrame) -> DataFrame:
    """Tiles with the ids of their features and the extent of the shapes."""
    shapes = F.transform("features", lambda f: f["shape"])
    told = _with_extent(tiles.select("z", "x", "y", "features", "feature_count", "label_count"), F.flatten(shapes))
    return told.withColumn("feature_ids", F.array_join(F.transform("features", lambda f: f["feature_id"]), ",")).drop("features")


def q13_parcel_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every parcel tile with the extent of their clipped shapes; label_count counts those whose label the tile owns."""
    return tile_summary(tile_rows(parcel_features(spark, sf_dir)))


def geo_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, box and envelope of all parcels of each county (AGG13)."""
    f = parcel_features(spark, sf_dir).withColumn("area", area(F.col("geom")))
    return f.groupBy("county_id").agg(F.sum("area").alias("area"), F.min("bbox.minx").alias("minx"), F.min("bbox.miny").alias("miny"), F.max("bbox.maxx").alias("maxx"), F.max("bbox.maxy").alias("maxy"))


#: Coarse zoom at which tiles and counties meet by equality, and zooms of county tiles.
COARSE, COUNTY_ZOOMS = 8, (6, 7, 8, 9, 10)


def county_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties in Web Mercator metres, with box and label point (centroid)."""
    c = counties(spark, sf_dir)
    at = lambda x, y: F.struct(mercator_x(F.col(x)).alias("x"), mercator_y(F.col(y)).alias("y"))
    ring = F.array(at("minx", "miny"), at("maxx", "miny"), at("maxx", "maxy"), at("minx", "maxy"), at("minx", "miny"))
    c = c.select("county_id", F.array(F.array(ring)).alias("geom")).withColumn("bbox", bbox(F.col("geom")))
    return c.withColumn("label", F.coalesce(centroid_of(F.col("geom")), point_on_surface(F.col("geom")[0][0])))


def tile_cover(boundaries: DataFrame, tiles: DataFrame) -> DataFrame:
    """county_id, z, x, y of the tiles (z, x, y; none coarser than COARSE) that a boundary (county_id, geom, bbox) touches.

    Tiles meet boundaries by the coarse tile that holds them, and only tiles with
    features are asked, so that no boundary is spread over its fine tiles.
    """
    spread = tiles_touched(boundaries, (COARSE,)).select("county_id", "geom", F.col("x").alias("cx"), F.col("y").alias("cy"))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("z") - COARSE)).cast("int")
    met = tiles.withColumn("cx", up("x")).withColumn("cy", up("y")).join(F.broadcast(spread), ["cx", "cy"])  # a few rows for each county
    return met.where(meets_box(F.col("geom"), tile_envelope(F.col("z"), F.col("x"), F.col("y")))).select("county_id", "z", "x", "y")


def q12_tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of every zoom that hold parcels and touch a county, by county."""
    held = tiles_touched(parcel_features(spark, sf_dir), PARCEL_ZOOMS).select("z", "x", "y").distinct()
    return tile_cover(county_features(spark, sf_dir), held)


def q14_county_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of county tiles: outlines clipped to the tile's grid (its extent told), and labels, each owned by one tile."""
    f = county_features(spark, sf_dir)
    shapes = _with_shape(tiles_touched(f, COUNTY_ZOOMS), F.lit(256)).select("z", "x", "y", F.lit("counties").alias("sublayer"), "county_id", "shape")
    outlines = _with_extent(shapes, F.col("shape")).drop("shape")
    label = None
    for z in COUNTY_ZOOMS:
        at = f.select(F.lit(z).alias("z"), tile_x(F.col("label.x"), z).alias("x"), tile_y(F.col("label.y"), z).alias("y"), F.lit("county_labels").alias("sublayer"), "county_id")
        label = label.unionByName(at) if label else at
    return outlines.unionByName(label, allowMissingColumns=True)


def q16_tax_parcel_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of taxed parcels by year: features, their tax, and the extent of their clipped shapes. A shape is clipped once, whatever its years."""
    f = parcel_features(spark, sf_dir).select("id", "geom", "bbox")
    shapes = _with_extent(_with_shape(tiles_touched(f, PARCEL_ZOOMS), F.lit(16)).select("z", "x", "y", "id", "shape"), F.col("shape")).drop("shape")
    taxes = taxed_parcels(spark, sf_dir, True).select("id", "tax_year", "tax_amount")
    tiles = shapes.join(taxes, "id").groupBy("z", "x", "y", "tax_year")
    return tiles.agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("feature_count"), F.round(F.sum("tax_amount"), 4).alias("tax"), *[g(c).alias(c) for g, c in ((F.min, "px0"), (F.min, "py0"), (F.max, "px1"), (F.max, "py1"))])


def _store(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/landloom/tiles-{uuid.uuid4().hex}"


def q24_tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tiles of asked keys: at each parcel zoom the tile of every corner, null where nothing is stored. Tiles are built and stored once; the lookup reads their ranges."""
    path = _store(spark)
    upsert_tiles(tile_rows(parcel_features(spark, sf_dir)).withColumn("layer", F.lit("parcels")), path, list(PARCEL_ZOOMS))
    at = F.array(*[F.struct(F.lit(z).alias("z"), tile_x(F.col("mx"), z).alias("x"), tile_y(F.col("my"), z).alias("y")) for z in PARCEL_ZOOMS])
    asked = parcels(spark, sf_dir).select(F.explode(at).alias("t")).select(F.lit("parcels").alias("layer"), "t.*").distinct()
    return tile_summary(lookup_tiles(spark, path, asked))


def snk5_tile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of zooms 13 to 15 after a second write that builds them anew from the parcels of counties 3 and 7 alone: these tiles replace what was stored, others stay."""
    path, f, zooms = _store(spark), parcel_features(spark, sf_dir), PARCEL_ZOOMS[:3]
    for part in (f, f.where("county_id IN (3, 7)")):
        upsert_tiles(tile_rows(part, zooms).withColumn("layer", F.lit("parcels")), path, list(zooms))
    return tile_summary(spark.read.parquet(path).where("layer = 'parcels'"))


def agg16_build_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles stored and empty by zoom of a build over all tiles that touch a county, counted in the writing pass."""
    zooms = (10, 11, 12)
    candidates = tiles_touched(county_features(spark, sf_dir), zooms).select("z", "x", "y").distinct()
    tiles = candidates.join(tile_rows(parcel_features(spark, sf_dir), zooms), ["z", "x", "y"], "left").withColumn("layer", F.lit("parcels"))
    outcomes = upsert_tiles(tiles, _store(spark), list(zooms))
    return spark.createDataFrame([(z, o["stored"], o["empty"]) for z, o in outcomes.items()], "z int, stored long, empty long")


def q5_parcel_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview paths, and outlines simplified together, of asked feature ids (those divisible by 100, and ones that are not valid): ids are parsed and meet parcels by equality."""
    p = parcel_features(spark, sf_dir)
    asked = parcels(spark, sf_dir).where("id % 100 = 0").select(F.concat(F.lit(" "), (F.col("county_id") + F.when(F.col("id") % 300 == 0, 100).otherwise(0)).cast("string"), F.when(F.col("id") % 700 == 0, "-").otherwise("_"), F.col("id").cast("string")).alias("asked"))
    parts = F.split(F.trim("asked"), "_", 2)
    keys = asked.select("asked", F.get(parts, F.lit(0)).try_cast("int").alias("county_id"), F.get(parts, F.lit(1)).try_cast("long").alias("id")).where("county_id > 0 AND id > 0")
    asked = staged(p.join(keys, ["county_id", "id"]).select("feature_id", "geom"))
    degrees = F.transform("geom", lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda q: F.struct(lng_of(q["x"]).alias("x"), lat_of(q["y"]).alias("y")))))
    thin = simplified_together(asked.select(F.col("feature_id").alias("id"), degrees.alias("geom")).distinct(), *PREVIEW).withColumnRenamed("id", "feature_id").withColumnRenamed("geom", "thin")
    coordinates = F.transform("thin", lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda q: F.array(q["x"], q["y"]))))
    told = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")))
    return asked.join(thin, "feature_id").select("feature_id", preview_path(F.col("geom")).alias("path"), told.alias("geometry"))


def agg12_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square regions of fewer than 500 parcels each, as coarse as can be, ten levels deep at most: counts at the finest level, summed upwards, choose each parcel's first small one."""
    deepest, first = 16, 6
    p = parcels(spark, sf_dir).where("processed IS NULL AND objectid IS NOT NULL")
    fine = p.groupBy(tile_x(F.col("mx"), deepest).alias("fx"), tile_y(F.col("my"), deepest).alias("fy")).agg(F.count("*").alias("m"))
    levels = fine.withColumn("z", F.explode(F.sequence(F.lit(first), F.lit(deepest))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), deepest - F.col("z"))).cast("int")
    sums = levels.groupBy("z", up("fx").alias("x"), up("fy").alias("y")).agg(F.sum("m").alias("n"))
    above = sums.select((F.col("z") + 1).alias("z"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("n").alias("over"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    joined = sums.withColumn("ux", half("x")).withColumn("uy", half("y")).join(above, ["z", "ux", "uy"], "left")
    small = (F.col("n") < 500) | (F.col("z") == deepest)
    return joined.where(small & (F.col("over").isNull() | (F.col("over") >= 500))).select("z", "x", "y", "n")


QUERIES = {f.__name__: f for f in (q15_tax_heatmap, q13_parcel_tiles, geo_measures, q12_tile_cover, q14_county_tiles, q16_tax_parcel_tiles, q24_tile_lookup, snk5_tile_upsert, agg16_build_outcomes, q5_parcel_previews, agg12_regions)}
_W = repr(WORLD)
_CLIP = lambda b, x0, y0, x1, y1: f"round((greatest({x0}, ex0 - w * {b} / 4096) - ex0) / w * 4096)::INT AS px0, round((ey1 - least({y1}, ey1 + w * {b} / 4096)) / w * 4096)::INT AS py0, round((least({x1}, ex0 + w + w * {b} / 4096) - ex0) / w * 4096)::INT AS px1, round((ey1 - greatest({y0}, ey1 - w - w * {b} / 4096)) / w * 4096)::INT AS py1"
ORACLES = {
    "q15_tax_heatmap": with_tables("parcels parcel_taxes taxes", f""", levels AS (SELECT unnest(range({COARSEST}, {FINEST + 1}))::INT AS z),
      cells AS (SELECT z, tax_year, floor(mx / ({_W} / pow(2, z) / {CELLS}))::BIGINT AS ix, floor(my / ({_W} / pow(2, z) / {CELLS}))::BIGINT AS iy, tax_amount FROM parcels JOIN taxes ON id = taxes.parcel_id, levels WHERE tax_amount > 0 AND processed IS NULL AND objectid IS NOT NULL)
      SELECT z, tax_year, ix, iy, (floor(ix / {CELLS}) + pow(2, z - 1))::BIGINT AS x, (pow(2, z - 1) - 1 - floor(iy / {CELLS}))::BIGINT AS y, round(avg(tax_amount), 6) AS mean_tax, count(*) AS n FROM cells GROUP BY ALL""").replace(" , levels", ", levels"),
    "q13_parcel_tiles": with_tables("parcels", f""", levels AS (SELECT unnest(range(13, 20))::INT AS z), p AS (SELECT *, county_id::VARCHAR || '_' || objectid::VARCHAR AS fid, ({_W} / pow(2, z)) AS w FROM parcels, levels WHERE processed IS NULL AND objectid IS NOT NULL),
      r AS (SELECT *, floor((mx + {_W} / 2) / w)::INT AS x0, floor((mx + side + {_W} / 2) / w)::INT AS x1, floor(({_W} / 2 - (my + side)) / w)::INT AS y0, floor(({_W} / 2 - my) / w)::INT AS y1, CASE WHEN site_address IS NOT NULL THEN floor((mx + side / 2 + {_W} / 2) / w)::INT END AS cx, floor(({_W} / 2 - (my + side / 2)) / w)::INT AS cy FROM p),
      t AS (SELECT *, x::INT AS tx, unnest(range(y0, y1 + 1))::INT AS ty FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM r)),
      e AS (SELECT *, tx * w - {_W} / 2 AS ex0, {_W} / 2 - ty * w AS ey1, CASE WHEN z >= 18 THEN 16 WHEN z >= 17 THEN 32 ELSE 256 END AS px FROM t), s AS (SELECT z, tx, ty, fid, cx, cy, {_CLIP("px", "mx", "my", "mx + side", "my + side")} FROM e)
      SELECT z, tx AS x, ty AS y, string_agg(fid, ',' ORDER BY fid) AS feature_ids, count(*) AS feature_count, count(*) FILTER (tx = cx AND ty = cy) AS label_count, min(px0) AS px0, min(py0) AS py0, max(px1) AS px1, max(py1) AS py1 FROM s GROUP BY ALL""").replace(" , levels", ", levels"),
    "geo_measures": with_tables("parcels", "SELECT county_id, sum(side * side) AS area, min(mx) AS minx, min(my) AS miny, max(mx + side) AS maxx, max(my + side) AS maxy FROM parcels WHERE processed IS NULL AND objectid IS NOT NULL GROUP BY county_id"),
}
_PARTS = f"""p AS (SELECT *, county_id::VARCHAR || '_' || objectid::VARCHAR AS fid, ({_W} / pow(2, z)) AS w FROM parcels, levels WHERE processed IS NULL AND objectid IS NOT NULL),
      r AS (SELECT *, floor((mx + {_W} / 2) / w)::INT AS x0, floor((mx + side + {_W} / 2) / w)::INT AS x1, floor(({_W} / 2 - (my + side)) / w)::INT AS y0, floor(({_W} / 2 - my) / w)::INT AS y1 FROM p),
      t AS (SELECT *, x::INT AS tx, unnest(range(y0, y1 + 1))::INT AS ty FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM r))"""
_ENV = f"tx * w - {_W} / 2 AS ex0, {_W} / 2 - ty * w AS ey1"
_MERC = "radians(minx) * 6378137.0 AS bx0, radians(maxx) * 6378137.0 AS bx1, ln(tan(radians(miny) / 2 + pi() / 4)) * 6378137.0 AS by0, ln(tan(radians(maxy) / 2 + pi() / 4)) * 6378137.0 AS by1"
_LEVELS = lambda a, b: f", levels AS (SELECT unnest(range({a}, {b}))::INT AS z)"
ORACLES |= {
    "q12_tile_cover": with_tables("parcels counties", f"""{_LEVELS(13, 20)}, {_PARTS}, h AS (SELECT DISTINCT z, tx, ty, w, {_ENV} FROM t), c AS (SELECT county_id, {_MERC} FROM counties)
      SELECT county_id, z, tx AS x, ty AS y FROM h JOIN c ON bx0 <= ex0 + w AND bx1 >= ex0 AND by0 <= ey1 AND by1 >= ey1 - w"""),
    "q14_county_tiles": with_tables("counties", f"""{_LEVELS(6, 11)}, c AS (SELECT county_id, {_MERC}, z, {_W} / pow(2, z) AS w FROM counties, levels),
      r AS (SELECT *, unnest(range(floor((bx0 + {_W} / 2) / w)::INT, floor((bx1 + {_W} / 2) / w)::INT + 1))::INT AS tx FROM c), t AS (SELECT *, unnest(range(floor(({_W} / 2 - by1) / w)::INT, floor(({_W} / 2 - by0) / w)::INT + 1))::INT AS ty FROM r), e AS (SELECT *, {_ENV} FROM t)
      SELECT z, tx AS x, ty AS y, 'counties' AS sublayer, county_id, {_CLIP(256, "bx0", "by0", "bx1", "by1")} FROM e UNION ALL SELECT z, floor(((bx0 + bx1) / 2 + {_W} / 2) / w)::INT, floor(({_W} / 2 - (by0 + by1) / 2) / w)::INT, 'county_labels', county_id, NULL, NULL, NULL, NULL FROM c"""),
    "q16_tax_parcel_tiles": with_tables("parcels parcel_taxes taxes", f"""{_LEVELS(13, 20)}, {_PARTS}, e AS (SELECT *, {_ENV} FROM t), s AS (SELECT z, tx AS x, ty AS y, id, {_CLIP(16, "mx", "my", "mx + side", "my + side")} FROM e), k AS (SELECT * FROM s WHERE px1 > px0 AND py1 > py0)
      SELECT z, x, y, tax_year, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS feature_count, round(sum(tax_amount), 4) AS tax, min(px0) AS px0, min(py0) AS py0, max(px1) AS px1, max(py1) AS py1 FROM k JOIN taxes ON id = taxes.parcel_id WHERE tax_amount > 0 GROUP BY ALL"""),
    "q24_tile_lookup": with_tables("parcels", f"""{_LEVELS(13, 20)}, asked AS (SELECT DISTINCT z, floor((mx + {_W} / 2) / w)::INT AS x, floor(({_W} / 2 - my) / w)::INT AS y FROM (SELECT *, {_W} / pow(2, z) AS w FROM parcels, levels)), tiles AS ({ORACLES["q13_parcel_tiles"]})
      SELECT z, x, y, feature_ids, feature_count, label_count, px0, py0, px1, py1 FROM asked LEFT JOIN tiles USING (z, x, y)"""),
    "q5_parcel_previews": with_tables("parcels", """SELECT county_id::VARCHAR || '_' || objectid::VARCHAR AS feature_id, 'M5.0 59.0 L59.0 59.0 L59.0 5.0 L5.0 5.0 L5.0 59.0 Z' AS path,
      '{"type":"MultiPolygon","coordinates":[[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]]}' AS geometry
      FROM (SELECT *, round(degrees(mx / 6378137.0), 5) AS x0, round(degrees((mx + side) / 6378137.0), 5) AS x1, round(degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2), 5) AS y0, round(degrees(2 * atan(exp((my + side) / 6378137.0)) - pi() / 2), 5) AS y1 FROM parcels) WHERE processed IS NULL AND objectid IS NOT NULL AND id % 100 = 0 AND id % 300 <> 0 AND id % 700 <> 0 AND county_id > 0"""),
    "agg12_regions": with_tables("parcels", f"""{_LEVELS(6, 17)}, c AS (SELECT z, floor((mx + {_W} / 2) / ({_W} / pow(2, z)))::INT AS x, floor(({_W} / 2 - my) / ({_W} / pow(2, z)))::INT AS y, count(*) AS n FROM parcels, levels WHERE processed IS NULL AND objectid IS NOT NULL GROUP BY ALL)
      SELECT c.z, c.x, c.y, c.n FROM c LEFT JOIN c AS u ON u.z = c.z - 1 AND u.x = c.x // 2 AND u.y = c.y // 2 WHERE (c.n < 500 OR c.z = 16) AND (u.n IS NULL OR u.n >= 500)"""),
}
_Q13 = ORACLES["q13_parcel_tiles"]
_FEW = _Q13.replace("range(13, 20)", "range(13, 16)")
ORACLES |= {
    "snk5_tile_upsert": f"WITH old AS ({_FEW}), new AS ({_FEW.replace('objectid IS NOT NULL)', 'objectid IS NOT NULL AND county_id IN (3, 7))')}) SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (z, x, y)",
    "agg16_build_outcomes": with_tables("counties", f"""{_LEVELS(10, 13)}, c AS (SELECT {_MERC}, z, {_W} / pow(2, z) AS w FROM counties, levels), r AS (SELECT *, unnest(range(floor((bx0 + {_W} / 2) / w)::INT, floor((bx1 + {_W} / 2) / w)::INT + 1))::INT AS x FROM c),
      t AS (SELECT DISTINCT z, x, y FROM (SELECT z, x, unnest(range(floor(({_W} / 2 - by1) / w)::INT, floor(({_W} / 2 - by0) / w)::INT + 1))::INT AS y FROM r)), held AS ({_Q13.replace("range(13, 20)", "range(10, 13)")})
      SELECT z, count(feature_count) AS stored, count(*) - count(feature_count) AS empty FROM t LEFT JOIN held USING (z, x, y) GROUP BY z"""),
}
ORACLES = {k: v.replace(" , levels", ", levels") for k, v in ORACLES.items()}
