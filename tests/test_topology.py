"""Simplifying and dissolving shapes."""

import math
import random

import numpy as np
import pyspark.sql.functions as F

from landloom.functions.geo import area
from landloom.operators import topology
from landloom.operators.topology import GEOMETRY, arcs_of, dissolved, line_simplified, lines_simplified, rings_of, segment_crossings, simplified_rings, simplified_together
from landloom.sources.tables import lots

SCHEMA = f"id long, geom {GEOMETRY}"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def test_line_against_recursion():
    def plain(points, a, b, tolerance, kept):
        best, at = 0.0, None
        (ax, ay), (bx, by) = points[a], points[b]
        for i in range(a + 1, b):
            x, y = points[i]
            length = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)) if length else 0
            far = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            if far > best + 1e-12:
                best, at = far, i
        if at is not None and best > tolerance:
            kept.add(at)
            plain(points, a, at, tolerance, kept)
            plain(points, at, b, tolerance, kept)

    rng = random.Random(4)
    for _ in range(200):
        points = [(rng.random(), rng.random()) for _ in range(rng.randrange(2, 40))]
        kept = {0, len(points) - 1}
        plain(points, 0, len(points) - 1, 0.2, kept)
        assert set(np.flatnonzero(line_simplified(np.array(points), 0.2)).tolist()) == kept
    assert line_simplified(np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float), 9, 2).sum() == 4


def test_islands_neighbours_and_small_rings(spark):
    wavy = [(x, (x % 2) * 0.1) for x in range(11)]
    low = ring(*wavy, (10, -5), (0, -5))
    high = ring((0, 5), *[(x, 5) for x in (10,)], *reversed(wavy))
    hole = [(20 + 3 * math.cos(i / 40 * 2 * math.pi), 3 * math.sin(i / 40 * 2 * math.pi)) for i in range(40)]
    rows = [(1, [[low]]), (2, [[high]]), (3, [[box(15, -5, 25, 5), ring(*reversed(hole))]]), (4, [[ring(*hole)]]), (5, [[box(50, 50, 50.01, 50.01)]]), (6, None), (7, []), (8, [[[{"x": 0.0, "y": 0.0}] * 3]])]
    got = {r.id: r for r in simplified_together(spark.createDataFrame(rows, SCHEMA), 0.5).withColumn("area", area(F.col("geom"))).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    edges = lambda r: {frozenset(((a["x"], a["y"]), (b["x"], b["y"]))) for a, b in zip(r, r[1:], strict=False)}
    assert edges(got[1].geom[0][0]) & edges(got[2].geom[0][0]) == {frozenset(((0, 0), (10, 0)))}
    assert edges(got[3].geom[0][1]) == edges(got[4].geom[0][0]) and 4 <= len(got[4].geom[0][0]) < 20  # island and hole alike
    assert len(got[5].geom[0][0]) >= 4 and got[5].area > 0  # far below the tolerance, and still a ring
    alone = {r.id: r.geom for r in simplified_rings(spark.createDataFrame(rows[:5], SCHEMA), 0.5).collect()}
    assert len(alone[1][0][0]) == 5 and 5 not in alone


def test_arcs_that_would_cross_stay(spark):
    """A lot that stands into a bay whose shore would be straightened through it."""
    shore = ring((0, 0), (4, 0), (5, -0.9), (6, 0), (10, 0), (10, -5), (0, -5))
    lot = ring((4.8, 0.1), (5.2, 0.1), (5, -0.4))
    geom = {r.id: r.geom for r in simplified_together(spark.createDataFrame([(1, [[shore]]), (2, [[lot]])], SCHEMA), 1).collect()}
    assert {(p["x"], p["y"]) for p in geom[1][0][0]} >= {(5, -0.9)}


def test_union_with_holes_parts_and_touching_corners(spark):
    cells = [(x, y) for x in range(5) for y in range(5) if (x, y) not in {(1, 1), (3, 3), (2, 2)}] + [(5, 5), (8, 0)]
    rows = [(x % 2 + 10 * 0, [[box(x, y, x + 1, y + 1)]]) for x, y in cells]
    whole = dissolved(spark.createDataFrame([(7, g) for _, g in rows], SCHEMA)).collect()
    assert len(whole) == 1
    parts = whole[0].geom
    assert sorted(len(p) for p in parts) == [1, 1, 4]  # three holes that touch in corners, a part that touches in one, a part apart
    size = lambda r: sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:], strict=False)) / 2
    assert sum(size(r) for p in parts for r in p) == len(cells) and all(size(p[0]) > 0 and all(size(h) < 0 for h in p[1:]) for p in parts)
    turned = spark.createDataFrame([(1, [[list(reversed(box(0, 0, 1, 1)))]]), (1, [[box(1, 0, 2, 1)]]), (1, None)], SCHEMA)
    assert dissolved(turned).select(area(F.col("geom")).alias("a")).first()["a"] == 2


def test_crossings_against_all_pairs(spark):
    rng = random.Random(8)
    lines = [(str(i).zfill(3), *[float(rng.randrange(-6, 7)) for _ in range(4)]) for i in range(60)]
    lines = [s for s in lines if s[1:3] != s[3:5]]

    def side(p, q, r):
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    want = set()
    for s in lines:
        for t in lines:
            a, b, c, d = s[1:3], s[3:5], t[1:3], t[3:5]
            if s[0] >= t[0] or max(min(a[0], b[0]), min(c[0], d[0])) > min(max(a[0], b[0]), max(c[0], d[0])) or max(min(a[1], b[1]), min(c[1], d[1])) > min(max(a[1], b[1]), max(c[1], d[1])):
                continue
            if side(a, b, c) * side(a, b, d) > 0 or side(c, d, a) * side(c, d, b) > 0:
                continue
            ends = {a, b} & {c, d}
            if ends:
                if side(a, b, c) != 0 or side(a, b, d) != 0:
                    continue
                (e,) = ends if len(ends) == 1 else (None,)
                if e is not None:
                    f, g = (a if b == e else b), (c if d == e else d)
                    if (f[0] - e[0]) * (g[0] - e[0]) + (f[1] - e[1]) * (g[1] - e[1]) < 0:
                        continue
            want.add((s[0], t[0]))
    got = segment_crossings(spark.createDataFrame(lines, "key string, ax double, ay double, bx double, by double"), 2.5)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_many_lines_at_once_as_one_by_one():
    rng = random.Random(9)
    lines = [[(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(1, 30))] for _ in range(300)] + [[(0, 0), (5, 9), (0, 0)], [(3, 3)] * 4]
    tolerance = np.array([rng.choice([0, 0.5, 1, 3]) for _ in lines], float)
    got = lines_simplified(np.array([p for line in lines for p in line], float), np.cumsum([0, *map(len, lines)]), tolerance)
    want = [k for line, t in zip(lines, tolerance, strict=True) for k in line_simplified(np.array(line, float), t).tolist()]
    assert got.tolist() == want


def test_arcs_cut_and_named_alike(spark):
    """rings of several junctions, one and none, in either direction, with signed zeros; arcs that are shared have one key and run one way."""
    left, right = ring((-1, 0), (0, 0), (0, 1), (0, 2), (-1, 2)), ring((0, 2), (0, 1), (0, -0.0), (1, 0), (1, 2))
    alone, knot = ring((9, 9), (8, 7), (7, 9)), ring((0, 2), (0.2, 5), (-0.2, 5))
    rows = arcs_of(spark.createDataFrame([(1, [[left]]), (2, [[right]]), (3, [[alone]]), (4, [[list(reversed(alone))]]), (5, [[knot]])], SCHEMA)).collect()
    of = {i: sorted(([(p.x, p.y) for p in r.arc], r.nth, r.turned, r.arcs, r.key) for r in rows if r.id == i) for i in range(1, 6)}
    middle = [(0, 0), (0, 1), (0, 2)]
    assert [a[0] for a in of[1]] == [[(0, 0), (-1, 0), (-1, 2), (0, 2)], middle] and [a[0] for a in of[2]] == [middle, [(0, 0), (1, 0), (1, 2), (0, 2)]]
    assert of[1][1][4] == of[2][0][4] and {a[2] for a in (of[1][1], of[2][0])} == {False, True} and {a[3] for a in of[1] + of[2]} == {2}
    assert [a[0] for a in of[3]] == [[(7, 9), (8, 7), (9, 9), (7, 9)]] and of[3][0][4] == of[4][0][4] and of[3][0][3] == 1
    assert [a[0] for a in of[5]] == [[(0, 2), (-0.2, 5), (0.2, 5), (0, 2)]]


def test_later_rounds_take_mended_arcs_only(spark, monkeypatch):
    """after a round, arcs that were not wrong are neither simplified nor joined anew."""
    shore = ring((0, 0), (4, 0), (5, -0.9), (6, 0), (10, 0), (10, -5), (0, -5))
    lot = ring((4.8, 0.1), (5.2, 0.1), (5, -0.4))
    far = [(10 + i, [[box(100 * i, 100, 100 * i + 9, 109)]]) for i in range(20)]
    asked, plain = [], topology._thinned
    monkeypatch.setattr(topology, "_thinned", lambda arcs: (asked.append(arcs.count()), plain(arcs))[1])
    geom = {r.id: r.geom for r in simplified_together(spark.createDataFrame([(1, [[shore]]), (2, [[lot]]), *far], SCHEMA), 1).collect()}
    assert {(p["x"], p["y"]) for p in geom[1][0][0]} >= {(5, -0.9)} and len(geom) == 22
    assert asked[0] == 22 and len(asked) > 1 and max(asked[1:]) <= 2


def test_lots_are_laid_out_after_they_are_dealt(spark):
    """a filter on shapes (inferred from an explode) must not lay all of them out in the one task that reads the table."""
    lines = rings_of(lots(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert "lambdafunction" in "\n".join(lines[:at]) and "lambdafunction" not in "\n".join(lines[at:])
