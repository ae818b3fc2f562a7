"""Points in polygons and polygons that meet, against every pair."""

import random

import pyspark.sql.functions as F

from landloom.functions.geo import area, centroid_of, covers_any, meets_box
from landloom.operators.spatial import covering, points_in_polygons, polygons_meeting

SCHEMA = "id long, geom array<array<array<struct<x:double,y:double>>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def shapes(rng, n, reach=20):
    import math

    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 3)):
            cx, cy, k = rng.randrange(reach), rng.randrange(reach), rng.randrange(3, 30)
            star = lambda r: [(cx + round(r * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * j / k), 1), cy + round(r * (0.6 + 0.4 * rng.random()) * math.sin(2 * math.pi * j / k), 1)) for j in range(k)]  # noqa: E731, B023
            r = rng.choice([0.5, 2, 5])
            parts.append([ring(star(r)), ring(star(r / 4))] if rng.random() < 0.5 else [ring(star(r))])
        out.append((i, parts))
    return out + [(100, [[ring([(0, 0), (10, 0), (10, 10), (0, 10)]), ring([(2, 2), (4, 2), (4, 4), (2, 4)])]]), (101, None), (102, [])]


def edges(geom):
    return [((a["x"], a["y"]), (b["x"], b["y"])) for part in geom or [] for r in part for a, b in zip(r, r[1:], strict=False)]


def cross(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def covered(geom, x, y):
    odd = False
    for a, b in edges(geom):
        if cross(a, b, (x, y)) == 0 and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]):
            return True
        if (a[1] > y) != (b[1] > y) and (cross(a, b, (x, y)) > 0) == (b[1] > a[1]):
            odd = not odd
    return odd


def test_points_against_every_polygon(spark):
    rng = random.Random(5)
    held = shapes(rng, 25)
    points = [(i, rng.randrange(-20, 220) / 10, rng.randrange(-20, 220) / 10) for i in range(900)] + [(1000, 10.0, 5.0), (1001, 2.0, 3.0), (1002, 3.0, 3.0), (1003, 0.0, 0.0), (1004, None, 1.0)]
    points += [(2000 + i, *held[i % 25][1][0][0][0].values()) for i in range(25)]
    df, polygons = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(held, SCHEMA)
    got = {(r.p, r.id) for r in points_in_polygons(df, polygons).collect()}
    want = {(p, i) for p, x, y in points if x is not None for i, geom in held if covered(geom, x, y)}
    assert got == want and len(want) > 300
    direct = df.crossJoin(polygons.where("geom IS NOT NULL")).where(covers_any(F.col("geom"), F.col("x"), F.col("y"))).select("p", "id")
    assert {tuple(r) for r in direct.collect()} == want
    assert points_in_polygons(df, polygons.where("geom IS NULL")).collect() == [] and points_in_polygons(df.limit(0), polygons).collect() == []
    cells = covering(polygons.where("id = 100")).selectExpr("size(edges) = 0 as inner").groupBy("inner").count().collect()
    assert {r["inner"]: r["count"] for r in cells}[True] > 5  # most points need no test


def test_meetings_against_all_pairs(spark):
    rng = random.Random(6)
    left, right = shapes(rng, 20, 40), [(i, g) for i, g in shapes(rng, 20, 40)]
    left.append((200, [[ring([(3, 3), (3.5, 3), (3.5, 3.5)])]]))  # within the hole of 100
    left.append((201, [[ring([(1, 1), (1.5, 1), (1.5, 1.5)])]]))  # within 100
    left.append((202, [[ring([(10, 10), (60, 10), (60, 60)])]]))  # touches 100 in a corner

    def meet(a, b):
        for p, q in edges(a):
            for r, s in edges(b):
                if max(min(p[0], q[0]), min(r[0], s[0])) <= min(max(p[0], q[0]), max(r[0], s[0])) and max(min(p[1], q[1]), min(r[1], s[1])) <= min(max(p[1], q[1]), max(r[1], s[1])):
                    if cross(p, q, r) * cross(p, q, s) <= 0 and cross(r, s, p) * cross(r, s, q) <= 0:
                        return True
        return any(covered(b, p[0][0]["x"], p[0][0]["y"]) for p in a or []) or any(covered(a, p[0][0]["x"], p[0][0]["y"]) for p in b or [])

    want = {(i, j) for i, a in left for j, b in right if meet(a, b)}
    got = polygons_meeting(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
    assert {tuple(r) for r in got.collect()} == want and (200, 100) not in want and {(201, 100), (202, 100)} <= want


def test_measures_with_holes_and_parts(spark):
    geom = [[ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (1, 3), (3, 3), (3, 1)])], [ring([(10, 0), (10, 2), (12, 2), (12, 0)])]]
    box = lambda *b: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(b, ("minx", "miny", "maxx", "maxy"), strict=True)])
    df = spark.createDataFrame([(1, geom)], SCHEMA)
    r = df.select(area(F.col("geom")).alias("area"), centroid_of(F.col("geom")).alias("mid"), meets_box(F.col("geom"), box(1.5, 1.5, 2, 2)).alias("hole"), meets_box(F.col("geom"), box(0.2, 0.2, 0.4, 0.4)).alias("inside"), meets_box(F.col("geom"), box(3.5, 1.5, 11, 1.8)).alias("across"), meets_box(F.col("geom"), box(5, 0, 9, 9)).alias("between")).first()
    assert r.area == 16 and (r.mid.x, r.mid.y) == ((2 * 12 + 11 * 4) / 16, (2 * 12 + 1 * 4) / 16)
    assert (r.hole, r.inside, r.across, r.between) == (False, True, True, False)
