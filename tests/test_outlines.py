"""Outlines that are no one's row: measures of unions, and unions met by their members."""

from landloom.operators.spatial import FEW_EDGES, polygons_meeting
from landloom.operators.topology import GEOMETRY, outline_measures
from tests.test_topology import box, ring

SCHEMA = f"id long, geom {GEOMETRY}"


def test_measures_of_unions_with_holes_and_parts(spark):
    cells = [(x, y) for x in range(5) for y in range(5) if (x, y) not in {(1, 1), (3, 3), (2, 2)}] + [(5, 5), (8, 0)]
    rows = [(7, [[box(x, y, x + 1, y + 1)]]) for x, y in cells] + [(8, [[box(0, 0, 9, 9), ring((3, 3), (4, 3), (4, 4), (3, 4))]]), (8, None)]
    got = {r.id: tuple(r)[1:] for r in outline_measures(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {7: (24.0, 0.0, 0.0, 9.0, 6.0, 40), 8: (80.0, 0.0, 0.0, 9.0, 9.0, 8)}


def test_ids_of_several_rows_meet_by_any_of_them(spark):
    many = [(10 * i / FEW_EDGES, 0) for i in range(2 * FEW_EDGES)]
    left = [(1, [[box(0, 0, 10, 10)]]), (2, [[box(21, 1, 22, 2)]]), (3, [[box(100, 0, 101, 1)]])]
    right = [(5, [[box(4, 4, 5, 5)]]), (5, [[ring(*many, (20 + 9, 9), (20, 9))]]), (5, [[box(20, 0, 30, 10)]]), (6, [[box(9, 9, 12, 12)]]), (6, [[box(200, 0, 201, 1)]])]
    met = polygons_meeting(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
    assert sorted(map(tuple, met.collect())) == [(1, 5), (1, 6), (2, 5)]
