"""Geometry as columns: Web Mercator, tiles, grid cells, and polygons as nested arrays of points."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius and circumference of Web Mercator in metres, and cells of a heatmap tile's side.
EARTH_RADIUS, WORLD, CELLS = 6378137.0, 40075016.68557849, 64


def lng_of(x: Column) -> Column:
    return F.degrees(x / EARTH_RADIUS)


def lat_of(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - pi / 2)


def mercator_x(lng: Column) -> Column:
    return F.radians(lng) * EARTH_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.radians(lat) / 2 + pi / 4)) * EARTH_RADIUS


def tile_x(x: Column, zoom: int) -> Column:
    return F.floor((x + WORLD / 2) / (WORLD / 2**zoom)).cast("int")


def tile_y(y: Column, zoom: int) -> Column:
    return F.floor((WORLD / 2 - y) / (WORLD / 2**zoom)).cast("int")


def cell(v: Column, zoom: int) -> Column:
    """Index of the grid cell, anchored at 0; a cell of one zoom holds four of the next."""
    return F.floor(v / (WORLD / 2**zoom / CELLS)).cast("long")


def tile_envelope(z: Column, x: Column, y: Column) -> Column:
    width = F.lit(WORLD) / F.pow(F.lit(2.0), z)
    return F.struct((x * width - WORLD / 2).alias("minx"), (WORLD / 2 - (y + 1) * width).alias("miny"), ((x + 1) * width - WORLD / 2).alias("maxx"), (WORLD / 2 - y * width).alias("maxy"))


def square(x: Column, y: Column, side: Column) -> Column:
    """A polygon (one ring) around a lower left corner."""
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(F.array(F.array(point(x, y), point(x + side, y), point(x + side, y + side), point(x, y + side), point(x, y))))


def bbox(geometry: Column) -> Column:
    """Bounding box of a multipolygon (polygons of rings of points)."""
    points = F.flatten(F.flatten(geometry))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def ring_sums(ring: Column) -> Column:
    """Twice the signed area of a ring and the moments of its centroid, relative to its first point."""
    o = ring[0]
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))

    def add(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"] - o["x"], e["a"]["y"] - o["y"], e["b"]["x"] - o["x"], e["b"]["y"] - o["y"]
        cross = ax * by - bx * ay
        return F.struct((s["area"] + cross).alias("area"), (s["mx"] + (ax + bx) * cross).alias("mx"), (s["my"] + (ay + by) * cross).alias("my"))

    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(edges, zero, add)


def area(geometry: Column) -> Column:
    """Planar area; the first ring of a polygon is its shell, the others are holes."""
    of = lambda ring: F.abs(ring_sums(ring)["area"]) / 2
    polygon = lambda rings: F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), of(rings[0]), lambda s, ring: s - of(ring))
    return F.aggregate(geometry, F.lit(0.0), lambda s, rings: s + polygon(rings))


def centroid(ring: Column) -> Column:
    """Centroid of a ring."""
    s = ring_sums(ring)
    return F.struct((ring[0]["x"] + s["mx"] / (3 * s["area"])).alias("x"), (ring[0]["y"] + s["my"] / (3 * s["area"])).alias("y"))


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring covers a point, its edges included."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))

    def cross(e: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])

    on_edge = F.exists(edges, lambda e: (cross(e) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
    crossing = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & ((cross(e) > 0) == (e["b"]["y"] > e["a"]["y"]))
    return on_edge | (F.size(F.filter(edges, crossing)) % 2 == 1)


def centroid_of(geometry: Column) -> Column:
    """Centroid of a multipolygon: of all shells without their holes; null without area."""
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(s: Column, ring: Column, hole: Column) -> Column:
        def moments(m: Column) -> Column:
            sign = F.when(m["area"] < 0, -1.0).otherwise(1.0) * F.when(hole, -1.0).otherwise(1.0)
            at = lambda axis, k: m[k] / 3 + m["area"] * ring[0][axis]
            return F.struct((s["area"] + sign * m["area"]).alias("area"), (s["mx"] + sign * at("x", "mx")).alias("mx"), (s["my"] + sign * at("y", "my")).alias("my"))

        return F.transform(F.array(ring_sums(ring)), moments)[0]

    rings = F.flatten(F.transform(geometry, lambda rings: F.transform(rings, lambda r, i: F.struct(r.alias("r"), (i > 0).alias("hole")))))
    total = F.aggregate(rings, zero, lambda s, r: add(s, r["r"], r["hole"]))
    return F.transform(F.array(total), lambda t: F.when(t["area"] > 0, F.struct((t["mx"] / t["area"]).alias("x"), (t["my"] / t["area"]).alias("y"))))[0]


def covers_any(geometry: Column, x: Column, y: Column) -> Column:
    """Whether polygons with holes and parts cover a point: on a ring, or inside an odd number of all rings."""

    def of(ring: Column) -> Column:
        cross = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
        on = lambda e: (cross(e) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
        passed = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & ((cross(e) > 0) == (e["b"]["y"] > e["a"]["y"]))
        return F.transform(F.array(edges_of_ring(ring)), lambda edges: F.struct(F.exists(edges, on).alias("on"), F.size(F.filter(edges, passed)).alias("n")))[0]

    rings = F.transform(F.flatten(geometry), of)
    return F.exists(rings, lambda r: r["on"]) | (F.aggregate(rings, F.lit(0), lambda s, r: s + r["n"]) % 2 == 1)


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 3958.8 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


#: Fixed values of the WGS 84 ellipsoid: its half axis and eccentricity.
HALF_AXIS, ECCENTRICITY = 6378137.0, 0.0818191908426215


def geodesic_area(geometry: Column) -> Column:
    """Square metres on the ellipsoid of polygons in Web Mercator metres; edges run straight in an equal-area projection. Holes count off."""

    def strip(y: Column) -> Column:  # twice the area under a parallel, for a turn of one radian, in half axes squared
        s = F.sin(F.radians(lat_of(y)))
        es = ECCENTRICITY * s
        return (1 - ECCENTRICITY**2) * (s / (1 - es * es) - F.ln((1 - es) / (1 + es)) / (2 * ECCENTRICITY))

    def of(ring: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))
        turn = lambda e: (e["b"]["x"] - e["a"]["x"]) / EARTH_RADIUS
        return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + turn(e) * (strip(e["a"]["y"]) + strip(e["b"]["y"])) / 2)) * (HALF_AXIS**2 / 2)

    polygon = lambda rings: F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), of(rings[0]), lambda s, ring: s - of(ring))
    return F.aggregate(geometry, F.lit(0.0), lambda s, rings: s + polygon(rings))


def parsed_geometry(kind: Column, coordinates: Column) -> Column:
    """A GeoJSON geometry's coordinates (as text) as polygons of rings of points; a polygon becomes a multipolygon of one, other kinds null."""
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    polygons = lambda ps: F.transform(ps, lambda rings: F.transform(rings, ring))
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", polygons(F.array(one))).when(kind == "MultiPolygon", polygons(many))


def parsed_wkt(wkt: Column) -> Column:
    """POLYGON and MULTIPOLYGON texts as polygons of rings of points; null for others."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:MULTI)?POLYGON\s*(?:Z\s*)?(\(.*\))\s*$", 1)
    polygons = F.when(F.rlike(wkt, F.lit(r"(?i)^\s*MULTI")), F.substring(body, F.lit(2), F.length(body) - 2)).otherwise(body)
    number = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    ring = lambda r: F.transform(F.split(F.regexp_replace(r, r"[()]", ""), ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    rings = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\(([^()]*)\)"), F.lit(1)), ring)
    return F.when(body != "", F.transform(F.regexp_extract_all(polygons, F.lit(r"\((?:\s*,?\s*\([^()]*\))+\s*\)"), F.lit(0)), rings))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def buffer_pixels(z: Column) -> Column:
    """Pixels that a parcel tile's features may stand out of it."""
    return F.when(z >= 18, 16).when(z >= 17, 32).otherwise(256)


def edges_of_ring(ring: Column) -> Column:
    """Segments a, b of a line of points, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))


def _cut(ring: Column, axis: str, limit: Column, above: bool) -> Column:
    """A closed ring cut at a line across an axis; what lies above it stays, or below; no points if nothing does, the ring as it is if all does."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] >= limit if above else p[axis] <= limit

    def crossing(a: Column, b: Column) -> Column:
        at = a[other] + (b[other] - a[other]) * (limit - a[axis]) / (b[axis] - a[axis])
        x, y = (limit, at) if axis == "x" else (at, limit)
        return F.struct(x.alias("x"), y.alias("y"))

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(b), F.array(crossing(a, b), b)).when(inside(a), F.array(crossing(a, b))).otherwise(F.slice(F.array(b), 1, 0))

    points = lambda r: F.flatten(F.transform(edges_of_ring(r), kept))
    closed = lambda ps: F.when(F.size(ps) > 2, F.concat(ps, F.slice(ps, 1, 1))).otherwise(F.slice(ps, 1, 0))
    return let(ring, lambda r: F.when(F.size(r) <= 3, F.slice(r, 1, 0)).when(F.forall(r, inside), r).otherwise(let(points(r), closed)))


def clipped(geometry: Column, z: Column, x: Column, y: Column, pixels: Column, extent: int = 4096, box: Column | None = None) -> Column:
    """The geometry clipped to a tile and so many pixels around it, on the tile's grid of whole numbers (y downwards); rings of less than three points go, null if none is left.
    With its bounding box, one that lies within is only put on the grid: what no line passes is not cut."""

    def of(env: Column) -> Column:
        width = env["width"]

        def on_grid(r: Column) -> Column:
            return F.transform(r, lambda p: F.struct(F.round((p["x"] - env["minx"]) / width * extent).cast("int").alias("x"), F.round((env["maxy"] - p["y"]) / width * extent).cast("int").alias("y")))

        def cut(r: Column) -> Column:
            for axis, limit, above in (("x", env["left"], True), ("x", env["right"], False), ("y", env["low"], True), ("y", env["high"], False)):
                r = _cut(r, axis, limit, above)
            return on_grid(r)

        shapes = lambda ring: F.transform(geometry, lambda rings: F.filter(F.transform(rings, ring), lambda r: F.size(F.array_distinct(r)) > 2))
        told = shapes(cut)
        if box is not None:
            within = (box["minx"] >= env["left"]) & (box["maxx"] <= env["right"]) & (box["miny"] >= env["low"]) & (box["maxy"] <= env["high"])
            told = F.when(within, shapes(lambda r: F.when(F.size(r) > 3, on_grid(r)).otherwise(on_grid(F.slice(r, 1, 0))))).otherwise(told)
        return F.filter(told, lambda rings: F.size(rings) > 0)

    def reach(env: Column) -> Column:
        width = F.lit(WORLD) / F.pow(F.lit(2.0), z)
        rest = width * pixels / extent
        sides = {"left": env["minx"] - rest, "right": env["maxx"] + rest, "low": env["miny"] - rest, "high": env["maxy"] + rest}
        return F.struct(env["minx"].alias("minx"), env["maxy"].alias("maxy"), width.alias("width"), *[v.alias(k) for k, v in sides.items()])

    return let(let(tile_envelope(z, x, y), reach), lambda env: let(of(env), lambda g: F.when(F.size(g) > 0, g)))


def meets_box(geometry: Column, box: Column) -> Column:
    """Whether polygons with holes and parts meet a box: a ring passes it, or its corner is covered (a box within a hole meets nothing)."""
    corners = [(box["minx"], box["miny"]), (box["maxx"], box["miny"]), (box["maxx"], box["maxy"]), (box["minx"], box["maxy"])]

    def passes(e: Column) -> Column:
        a, b = e["a"], e["b"]
        near = (F.least(a["x"], b["x"]) <= box["maxx"]) & (F.greatest(a["x"], b["x"]) >= box["minx"]) & (F.least(a["y"], b["y"]) <= box["maxy"]) & (F.greatest(a["y"], b["y"]) >= box["miny"])
        sides = [F.signum((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])) for x, y in corners]
        return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(F.flatten(geometry), lambda ring: F.exists(edges_of_ring(ring), passes)) | covers_any(geometry, *corners[0])


def point_on_surface(ring: Column) -> Column:
    """The middle of the widest span inside a ring at half its height."""

    def widest(half: Column) -> Column:
        crosses = F.filter(edges_of_ring(ring), lambda e: (e["a"]["y"] > half) != (e["b"]["y"] > half))
        xs = F.array_sort(F.transform(crosses, lambda e: e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * (half - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"])))
        spans = lambda held: F.transform(F.sequence(F.lit(1), F.size(held) - 1, F.lit(2)), lambda i: F.struct((F.element_at(held, i + 1) - F.element_at(held, i)).alias("width"), ((F.element_at(held, i + 1) + F.element_at(held, i)) / 2).alias("x")))
        return F.struct(let(xs, lambda held: F.array_max(spans(held))["x"]).alias("x"), half.alias("y"))

    ys = F.transform(ring, lambda p: p["y"])
    return let((F.array_min(ys) + F.array_max(ys)) / 2, widest)


def search_point(geometry: Column) -> Column:
    """lat, lng (degrees) of the point on the surface of the largest part of polygons in Web Mercator metres; null without a geometry."""
    largest = F.array_max(F.transform(geometry, lambda rings: F.struct(F.abs(ring_sums(rings[0])["area"]).alias("area"), rings[0].alias("ring"))))["ring"]
    return F.when(F.size(geometry) > 0, let(let(largest, point_on_surface), lambda p: F.struct(lat_of(p["y"]).alias("lat"), lng_of(p["x"]).alias("lng"))))


def preview_path(geometry: Column, box: int = 64, pad: int = 5) -> Column:
    """The rings as a path in a square box, y downwards, two decimals."""

    def of(b: Column) -> Column:
        scale = (box - 2 * pad) / F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"])
        wide, high = (b["maxx"] - b["minx"]) * scale, (b["maxy"] - b["miny"]) * scale
        point = lambda p: F.concat(F.round((p["x"] - b["minx"]) * scale + (box - wide) / 2, 2).cast("string"), F.lit(" "), F.round((b["maxy"] - p["y"]) * scale + (box - high) / 2, 2).cast("string"))
        return F.array_join(F.transform(F.flatten(geometry), lambda ring: F.concat(F.lit("M"), F.array_join(F.transform(ring, point), " L"), F.lit(" Z"))), " ")

    return let(bbox(geometry), of)


def quadrants(box: Column, overlap: float = 0.001) -> Column:
    """The four quarters of a box, each grown by a share of its sides."""
    midx, midy = (box["minx"] + box["maxx"]) / 2, (box["miny"] + box["maxy"]) / 2
    dx, dy = (box["maxx"] - box["minx"]) * overlap, (box["maxy"] - box["miny"]) * overlap
    part = lambda x0, y0, x1, y1: F.struct((x0 - dx).alias("minx"), (y0 - dy).alias("miny"), (x1 + dx).alias("maxx"), (y1 + dy).alias("maxy"))
    return F.array(part(box["minx"], box["miny"], midx, midy), part(midx, box["miny"], box["maxx"], midy), part(box["minx"], midy, midx, box["maxy"]), part(midx, midy, box["maxx"], box["maxy"]))
