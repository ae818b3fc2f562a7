"""Shapes as a whole: simplified together, measured by the outlines of their unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.geo import area, edges_of_ring
from landloom.operators.spatial import polygons_meeting
from landloom.operators.staging import staged
from landloom.operators.topology import outline_measures, simplified_together
from landloom.sources.tables import lots, with_tables

#: Metres by which a simplified border may differ.
TOLERANCE = 5


def geo10_shared_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lot simplified together with its neighbours: points, area, and how many of its segments a neighbour has too."""
    thin = staged(simplified_together(lots(spark, sf_dir), TOLERANCE, 3))
    segments = thin.select("id", F.explode(edges_of_ring(F.col("geom")[0][0])).alias("e")).select("id", F.least("e.a", "e.b").alias("low"), F.greatest("e.a", "e.b").alias("high"))
    pairs = segments.groupBy("low", "high").agg(F.count("*").alias("n"), F.min("id").alias("one"), F.max("id").alias("other")).where("n = 2")
    shared = pairs.select(F.explode(F.array("one", "other")).alias("id")).groupBy("id").agg(F.count("*").alias("shared"))
    return thin.join(shared, "id").select("id", F.size(F.col("geom")[0][0]).alias("n_points"), area(F.col("geom")).alias("area"), "shared")


def geo9_county_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all lots of each county: area (holes off), extent and number of segments of its outline, summed over the outline as it is spread over tasks."""
    return outline_measures(lots(spark, sf_dir).select(F.col("county_id").alias("id"), "geom")).withColumnRenamed("id", "county_id")


def jn12_counties_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lot with the counties whose outline (the union of their lots) it meets: its own and those of lots around it, also in a corner only.

    A shape meets a union if and only if it meets one of its members, so no county has to be one row.
    """
    held = staged(lots(spark, sf_dir))
    return polygons_meeting(held.select("id", "geom"), held.select(F.col("county_id").alias("id"), "geom")).select(F.col("left_id").alias("id"), F.col("right_id").alias("county_id"))


QUERIES = {f.__name__: f for f in (geo10_shared_borders, geo9_county_outlines, jn12_counties_met)}
_BUMP = lambda b: f"(10 * list_sum({b}))"
ORACLES = {
    "geo10_shared_borders": with_tables("lots", """, s AS (SELECT l.*, spike_s::INT AS ns, spike_n::INT AS nn, spike_w::INT AS nw, spike_e::INT AS ne FROM lots l)
      SELECT l.id, 5 + ns + nn + nw + ne AS n_points,
        (10000 + 1500 * (CASE WHEN (i + j) % 2 = 0 THEN 1 ELSE -1 END) * (-ns - nn - nw - ne))::DOUBLE AS area,
        CASE WHEN EXISTS (SELECT 1 FROM lots o WHERE o.i = l.i AND o.j = l.j - 1) THEN 1 + ns ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM lots o WHERE o.i = l.i AND o.j = l.j + 1) THEN 1 + nn ELSE 0 END
        + CASE WHEN EXISTS (SELECT 1 FROM lots o WHERE o.i = l.i - 1 AND o.j = l.j) THEN 1 + nw ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM lots o WHERE o.i = l.i + 1 AND o.j = l.j) THEN 1 + ne ELSE 0 END AS shared
      FROM s l""").replace(" , s AS", ", s AS"),
    "jn12_counties_met": with_tables("lots", "SELECT DISTINCT l.id, o.county_id FROM lots l JOIN lots o ON abs(o.i - l.i) <= 1 AND abs(o.j - l.j) <= 1"),
    "geo9_county_outlines": with_tables("lots", f""", b AS (SELECT l.county_id, 10000 - {_BUMP("bs")} + {_BUMP("bn")} - {_BUMP("bw")} + {_BUMP("be")} AS area, 100 * i + least(0, list_min(bw)) AS minx, 100 * j + least(0, list_min(bs)) AS miny, 100 * (i + 1) + greatest(0, list_max(be)) AS maxx, 100 * (j + 1) + greatest(0, list_max(bn)) AS maxy,
        10 * (4 - (SELECT count(*) FROM lots o WHERE o.county_id = l.county_id AND abs(o.i - l.i) + abs(o.j - l.j) = 1)) AS n FROM lots l)
      SELECT county_id, sum(area)::DOUBLE AS area, min(minx)::DOUBLE AS minx, min(miny)::DOUBLE AS miny, max(maxx)::DOUBLE AS maxx, max(maxy)::DOUBLE AS maxy, sum(n)::INT AS n_segments FROM b GROUP BY county_id""").replace(" , b AS", ", b AS"),
}
