"""Joins of points and polygons: coverings of polygons by grid cells, and polygons that meet.

Polygons are rows (id, geom); geom is polygons of rings of points. Inside is what an odd number of all its rings encloses (holes and
parts need no order), borders included. Null and empty geometries cover nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.geo import bbox, edges_of_ring
from landloom.operators.staging import staged

#: Cells along a polygon's longer side: about the root of its edges, within these.
LEAST_CELLS, MOST_CELLS = 8, 256
#: Points that a polygon's rings may have to be tested as a whole when polygons meet.
FEW_EDGES = 64


def _edges(geometry: Column) -> Column:
    return F.flatten(F.transform(F.flatten(geometry), lambda ring: F.when(F.size(ring) > 1, edges_of_ring(ring)).otherwise(F.slice(F.array(F.struct(F.lit(None).cast("struct<x:double,y:double>").alias("a"), F.lit(None).cast("struct<x:double,y:double>").alias("b"))), 1, 0))))


def _low(e: Column, axis: str) -> Column:
    return F.least(e["a"][axis], e["b"][axis])


def _high(e: Column, axis: str) -> Column:
    return F.greatest(e["a"][axis], e["b"][axis])


def _cross(e: Column, x: Column, y: Column) -> Column:
    return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])


def _left_of(e: Column, x: Column, y: Column) -> Column:
    """Whether the edge crosses the ray that runs to the left from a point."""
    return ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & ((_cross(e, x, y) < 0) == (e["b"]["y"] > e["a"]["y"]))


def _on(e: Column, x: Column, y: Column) -> Column:
    return (_cross(e, x, y) == 0) & x.between(_low(e, "x"), _high(e, "x")) & y.between(_low(e, "y"), _high(e, "y"))


def box_cells(polygons: DataFrame) -> DataFrame:
    """A covering of small polygons without computing: the one to four cells, about as large as a polygon, that its box touches, each with all its edges."""
    shapes = polygons.where("geom IS NOT NULL").select("id", _edges(F.col("geom")).alias("edges"), bbox(F.col("geom")).alias("box")).where("size(edges) > 0")
    wide = F.greatest(F.col("box.maxx") - F.col("box.minx"), F.col("box.maxy") - F.col("box.miny"), F.lit(1e-9))
    sized = shapes.withColumn("z", F.ceil(F.log2(wide)).cast("int"))
    at = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("z"))).cast("long")
    told = sized.withColumn("gx", F.explode(F.sequence(at("box.minx"), at("box.maxx")))).withColumn("gy", F.explode(F.sequence(at("box.miny"), at("box.maxy"))))
    return told.select("id", "z", "gx", "gy", "edges", F.lit(0).alias("odd"))


def covering(polygons: DataFrame) -> DataFrame:
    """id, z, gx, gy, edges, odd: cells (of side 2^z, finer for polygons of many edges) that a polygon touches.

    A cell without edges lies inside: its points need no test. In others a point is inside if the edges at its left,
    of those the cell keeps, and `odd` (the parity of edges that pass left of the whole cell) make an odd number. So a test takes the edges near its cell,
    not all of the polygon. Sides are powers of two, by which points are divided without rounding.
    """
    shapes = polygons.where("geom IS NOT NULL").select("id", _edges(F.col("geom")).alias("edges"), bbox(F.col("geom")).alias("box")).where("size(edges) > 0")
    wide = F.greatest(F.col("box.maxx") - F.col("box.minx"), F.col("box.maxy") - F.col("box.miny"), F.lit(1e-9))
    cells = F.least(F.greatest(F.sqrt(F.size("edges")), F.lit(LEAST_CELLS)), F.lit(MOST_CELLS))
    sized = shapes.withColumn("z", F.ceil(F.log2(wide / cells)).cast("int")).withColumn("side", F.pow(F.lit(2.0), F.col("z")))
    at = lambda v: F.floor(v / F.col("side")).cast("long")
    across = F.struct(at(F.col("box.minx")).alias("first"), at(F.col("box.maxx")).alias("last"))
    slabs = sized.select("id", "z", "side", across.alias("across"), F.explode("edges").alias("e")).withColumn("gy", F.explode(F.sequence(at(_low(F.col("e"), "y")), at(_high(F.col("e"), "y")))))
    rows = slabs.groupBy("id", "z", "side", "across", "gy").agg(F.collect_list("e").alias("edges")).withColumn("gx", F.explode(F.sequence(F.col("across.first"), F.col("across.last"))))
    side, x0, y0 = F.col("side"), F.col("gx") * F.col("side"), F.col("gy") * F.col("side")
    x1, y1 = x0 + side, y0 + side

    def meets(e: Column) -> Column:
        turns = [F.signum(_cross(e, x, y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
        return (_low(e, "x") <= x1) & (_high(e, "x") >= x0) & (_low(e, "y") <= y1) & (_high(e, "y") >= y0) & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)

    def left(e: Column) -> Column:  # of an edge that doesn't meet the cell: where it passes the cell's rows it is on one side of it
        y = (F.greatest(_low(e, "y"), y0) + F.least(_high(e, "y"), y1)) / 2
        x = F.when(e["a"]["y"] == e["b"]["y"], _low(e, "x")).otherwise(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]))
        return x < x0

    passing = lambda e: (_low(e, "y") <= y0) & (_high(e, "y") >= y1)
    near = F.filter("edges", meets)
    beside = F.filter("edges", lambda e: ~meets(e) & left(e))
    split = rows.withColumn("near", near).withColumn("beside", beside)
    odd = F.size(F.filter("beside", passing)) % 2
    partly = F.filter("beside", lambda e: ~passing(e))
    told = split.select("id", "z", "gx", "gy", "side", "near", odd.alias("odd"), partly.alias("partly"))
    middle_x, middle_y = (F.col("gx") + 0.5) * side, (F.col("gy") + 0.5) * side
    within = (F.size(F.filter("partly", lambda e: _left_of(e, middle_x, middle_y))) + F.col("odd")) % 2 == 1
    border = F.size("near") > 0
    kept = told.where(border | within)
    return kept.select("id", "z", "gx", "gy", F.when(border, F.concat("near", "partly")).otherwise(F.slice("near", 1, 0)).alias("edges"), F.when(border, F.col("odd")).otherwise(1).alias("odd"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, few: int = 0, known: DataFrame | None = None) -> DataFrame:
    """points (x, y, further columns) with the id of each polygon that covers them, a row for each; those of known (columns of points, id) are passed over before they are tested.

    Points meet cells by equality, once for each side of cells in use (asked first, a few numbers). One cell of many points
    is a skewed key of a small other side, which Spark splits. Polygons of few edges at most take the cells of their box and all their edges
    (the better way where there are about as many of them as points, which are then never sent to all tasks).
    """
    if few:
        edges = F.aggregate(F.flatten("geom"), F.lit(0), lambda s, ring: s + F.size(ring))
        cells = staged(covering(polygons.where(edges > few)).unionByName(box_cells(polygons.where(edges <= few)))).hint("merge")
    else:
        cells = staged(covering(polygons))
    levels = sorted(r[0] for r in cells.select("z").distinct().collect())
    if not levels:
        return points.select("*", F.lit(None).cast(cells.schema["id"].dataType).alias("id")).where(F.lit(False))
    spread = points.withColumn("z", F.explode(F.array(*map(F.lit, levels))))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("z"))).cast("long")
    met = spread.withColumn("gx", at("x")).withColumn("gy", at("y")).join(cells, ["z", "gx", "gy"])
    if known is not None:
        met = met.join(known.hint("merge"), known.columns, "left_anti")
    x, y = F.col("x"), F.col("y")
    inside = (F.size("edges") == 0) | F.exists("edges", lambda e: _on(e, x, y)) | ((F.size(F.filter("edges", lambda e: _left_of(e, x, y))) + F.col("odd")) % 2 == 1)
    return met.where(inside).select(*points.columns, "id")


def _segments(polygons: DataFrame) -> DataFrame:
    return polygons.where("geom IS NOT NULL").select("id", F.explode(_edges(F.col("geom"))).alias("e")).select("id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def spread_segments(segments: DataFrame, cell: float) -> DataFrame:
    """segments (ax, ay, bx, by) with gx, gy of the cells that they touch (some more, and some twice). Long ones are followed piece by piece, so that a slanting one isn't spread over its box."""
    pieces = F.greatest(F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / cell), F.lit(1))
    at = lambda c, i: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * i / F.col("_pieces")
    low = lambda c: F.floor((F.least(at(c, F.col("_i")), at(c, F.col("_i") + 1)) - cell * 1e-6) / cell).cast("long")
    high = lambda c: F.floor((F.greatest(at(c, F.col("_i")), at(c, F.col("_i") + 1)) + cell * 1e-6) / cell).cast("long")
    cut = segments.withColumn("_pieces", pieces.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    return cut.withColumn("gx", F.explode(F.sequence(low("x"), high("x")))).withColumn("gy", F.explode(F.sequence(low("y"), high("y")))).drop("_pieces", "_i")


def touch() -> Column:
    """Whether segments (ax, ay, bx, by) and (o_ax, ...) have a point in common."""
    c = F.col
    side = lambda p, q, r: F.signum((c(f"{q}x") - c(f"{p}x")) * (c(f"{r}y") - c(f"{p}y")) - (c(f"{q}y") - c(f"{p}y")) * (c(f"{r}x") - c(f"{p}x")))
    near = [(F.least(f"a{i}", f"b{i}") <= F.greatest(f"o_a{i}", f"o_b{i}")) & (F.least(f"o_a{i}", f"o_b{i}") <= F.greatest(f"a{i}", f"b{i}")) for i in "xy"]
    return near[0] & near[1] & (side("a", "b", "o_a") * side("a", "b", "o_b") <= 0) & (side("o_a", "o_b", "a") * side("o_a", "o_b", "b") <= 0)


def polygons_meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id of polygons (id, geom each) with a point in common.

    Either borders touch: segments meet by grid cells about as large as they are. Or a part lies wholly inside: the first point of each ring's
    part is looked up in the other side's covering, unless borders of the pair touch. No pair is tried that shares no cell. Ids may have several rows.
    """
    s, t = staged(_segments(left)), staged(_segments(right))
    cell = s.unionByName(t.select(*s.columns)).agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1.0
    other = spread_segments(t, 2 * cell).select("gx", "gy", *[F.col(k).alias(f"o_{k}") for k in t.columns])
    met = spread_segments(s, 2 * cell).join(other.hint("merge"), ["gx", "gy"]).where(touch())  # files of segments are small, their rows are not: no side is sent to all tasks
    borders = staged(met.select(F.col("id").alias("left_id"), F.col("o_id").alias("right_id")).distinct())
    first = lambda side, name: side.where("geom IS NOT NULL").select(F.col("id").alias(name), F.explode("geom").alias("rings")).select(name, F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][0]["y"].alias("y"))
    in_right = points_in_polygons(first(left, "left_id"), right, FEW_EDGES, borders.withColumnRenamed("right_id", "id")).select("left_id", F.col("id").alias("right_id"))
    in_left = points_in_polygons(first(right, "right_id"), left, FEW_EDGES, borders.withColumnRenamed("left_id", "id")).select(F.col("id").alias("left_id"), "right_id")
    return borders.unionByName(in_right).unionByName(in_left).distinct()
