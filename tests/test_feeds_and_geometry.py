import math

import pytest
from pyspark.sql import functions as F

from landloom.functions import geo, mapping, normalize
from landloom.sources import feeds
from tests.test_functions import one

L = F.lit
SQUARE = "geo.square(L(0.0), L(0.0), L(100.0))"


def ring(*points):
    return F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in points])


def box(x0, y0, x1, y1):
    return F.struct(L(float(x0)).alias("minx"), L(float(y0)).alias("miny"), L(float(x1)).alias("maxx"), L(float(y1)).alias("maxy"))


def test_texts(spark):
    assert one(spark, normalize.title_words(L("  new   YORK city "))) == "New York City"
    assert one(spark, normalize.base_url(L("https://a.example/x?y=1"))) == "https://a.example"
    assert one(spark, normalize.url_parameter(L("http://h/p?a=1&map_code=x%20y&z"), "map_code")) == "x%20y"
    assert one(spark, normalize.no_blanks(L(" 12 A\t3 "))) == "12A3"
    assert one(spark, normalize.copy_address(L("1 Oak St\n Macon ,GA"))) == "1 Oak St, Macon, GA"
    assert [one(spark, normalize.size_text(L(n))) for n in (5, 2048, 5 * 1024**2)] == ["5 B", "2.0 KB", "5.0 MB"]
    for old, new, out in (("A", "A1", "A1"), ("A", "B", "A B"), (None, "B", "B"), ("A", "", "A"), ("A", "A", "A"), (None, None, None)):
        assert one(spark, normalize.merged_district(L(old).cast("string"), L(new).cast("string"))) == out
    place = one(spark, normalize.log_position(L(500.0), L(0.0), L(1e6)))
    assert 0 < place < 1000 and abs(one(spark, normalize.log_value(L(place), L(0.0), L(1e6))) - 500) < 1e-6
    assert one(spark, normalize.log_position(L(-3.0), L(0.0), L(9.0))) == 0


def test_owner_blocks(spark):
    for block, site, name, address in (
        ("ANN LEE<br>12 Oak Street<br>MACON", "12 OAK ST", "ANN LEE", "12 Oak Street MACON"), ("ANN LEE<BR />P.O. BOX 9\nMACON", "", "ANN LEE", "P.O. BOX 9 MACON"), ("9 ELM RD", None, "", "9 ELM RD"),
        ("ANN LEE<br>CO BOB", "1 A ST", "ANN LEE CO BOB", ""), ("", "x", "", ""),
    ):
        got = one(spark, normalize.owner_block(L(block), L(site).cast("string")))
        assert (got["name"], got["address"]) == (name, address)


def test_boxes_tiles_and_projection(spark):
    assert one(spark, geo.overlaps(box(0, 0, 1, 1), box(1, 1, 2, 2))) and not one(spark, geo.overlaps(box(0, 0, 1, 1), box(1.1, 0, 2, 2)))
    env = one(spark, geo.tile_envelope(L(1), L(1), L(0)))
    assert (env["minx"], env["miny"]) == (0, 0) and env["maxx"] == env["maxy"] == geo.WORLD / 2
    for v in (-84.3, 12.0):
        assert abs(one(spark, geo.lng_of(geo.mercator_x(L(v)))) - v) < 1e-9 and abs(one(spark, geo.lat_of(geo.mercator_y(L(v)))) - v) < 1e-9
    parts = one(spark, geo.quadrants(box(0, 0, 10, 10), 0.0))
    assert [tuple(p) for p in parts] == [(0, 0, 5, 5), (5, 0, 10, 5), (0, 5, 5, 10), (5, 5, 10, 10)]


def test_geodesic_area(spark):
    """A quarter degree square at 33 degrees north, against the ellipsoid's radii of curvature there."""
    a, e2, lat = 6378137.0, geo.ECCENTRICITY**2, math.radians(33.125)
    w = 1 - e2 * math.sin(lat) ** 2
    true = (math.radians(0.25) * a * math.cos(lat) / math.sqrt(w)) * (math.radians(0.25) * a * (1 - e2) / w**1.5)
    x0, x1 = geo.mercator_x(L(-84.0)), geo.mercator_x(L(-83.75))
    y0, y1 = geo.mercator_y(L(33.0)), geo.mercator_y(L(33.25))
    shape = F.array(F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])))
    assert abs(one(spark, geo.geodesic_area(shape)) / true - 1) < 1e-5


def test_clipping_on_tile_edges(spark):
    width = geo.WORLD / 2**14
    shape = F.array(F.array(ring((-width / 2, -width / 2), (width / 2, -width / 2), (width / 2, width / 2), (-width / 2, width / 2), (-width / 2, -width / 2))))
    for x, y, spans in ((8192, 8191, (0, 2048, 2048, 4096)), (8191, 8191, (2048, 2048, 4096, 4096)), (8192, 8192, (0, 0, 2048, 2048))):
        got = one(spark, geo.clipped(shape, L(14), L(x), L(y), L(0)))[0][0]
        xs, ys = [p["x"] for p in got], [p["y"] for p in got]
        assert (min(xs), min(ys), max(xs), max(ys)) == spans and got[0] == got[-1]
    grown = one(spark, geo.clipped(shape, L(14), L(8192), L(8191), L(256)))[0][0]
    assert min(p["x"] for p in grown) == -256 and max(p["y"] for p in grown) == 4096 + 256
    assert one(spark, geo.clipped(shape, L(14), L(8200), L(8191), L(16))) is None
    touching = F.array(F.array(ring((width, 0), (2 * width, 0), (2 * width, width), (width, width), (width, 0))))
    assert one(spark, geo.clipped(touching, L(14), L(8192), L(8191), L(0))) is None  # only an edge is shared
    hole = F.array(F.array(ring((0, 0), (width, 0), (width, width), (0, width), (0, 0)), ring((1, 1), (1.1, 1), (1.1, 1.1), (1, 1))))
    assert len(one(spark, geo.clipped(hole, L(14), L(8192), L(8191), L(0)))[0]) == 1  # a hole of less than a grid step goes


def test_intersections_and_points_inside(spark):
    triangle = ring((0, 0), (10, 0), (0, 10), (0, 0))
    for b, meets in (((6, 6, 9, 9), False), ((5, 5, 9, 9), True), ((1, 1, 2, 2), True), ((-5, -5, 20, 20), True), ((10, 0, 12, 3), True), ((-3, 4, -1, 5), False)):
        assert one(spark, geo.meets_box(F.array(F.array(triangle)), box(*b))) is meets, b
    shape = ring((0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (0, 1), (0, 0))
    p = one(spark, geo.point_on_surface(shape))
    assert one(spark, geo.covers(shape, L(p["x"]), L(p["y"])))
    assert one(spark, geo.preview_path(F.array(F.array(ring((0, 0), (20, 0), (20, 10), (0, 0)))))) == "M5.0 45.5 L59.0 45.5 L59.0 18.5 L5.0 45.5 Z"


def test_mapping(spark):
    with pytest.raises(ValueError, match="SHOUT"):
        mapping.transformed(L("x"), "SHOUT()")
    for value, transform, out in (("a|b|GA|1", "CONCAT_ADDRESS", "a, b, GA 1"), ("|b|GA|1", "CONCAT_ADDRESS", "b, GA 1"), ("||GA|1", "CONCAT_ADDRESS()", "GA 1"), ("a|b", "CONCAT_ADDRESS", "a|b"), (" a | |b", "CONCAT", "a b"), ("4330 X RD", "EXTRACT_SITE_NUMBER", "4330"), ("A-B", "REPLACE('-', '/')", "A/B"), ("x", None, "x"), ("a,b", "REPLACE(a)", "a,b")):
        assert one(spark, mapping.transformed(L(value), transform)) == out
    for text, out in (("12.0", "12"), ("1.5E3", "1500"), ("0012", "0012"), ("x.0", "x.0")):
        assert one(spark, mapping.number_text(L(text))) == out
    assert one(spark, mapping.typed(L("43560"), mapping.FieldMapping("Shape_Area", "acres"))) == 1.0
    assert one(spark, mapping.typed(L("12a"), mapping.FieldMapping("X", "objectid"))) is None


def test_feeds_with_odd_documents(spark):
    docs = spark.createDataFrame([("junk",), ('{"features":[]}',), (None,), ('{"features":[{"attributes":{"A":"1"},"geometry":{"x":0,"y":0}}]}',)], "doc string")
    assert [(r["props"], r["geom"]) for r in feeds.features(docs).collect()] == [({"A": "1"}, None)]
    assert feeds.county_features(docs).count() == 0 and feeds.wkt_features(docs).count() == 0
    files = spark.createDataFrame([("30301-1234", "ATLANTA  city", "", "1"), ("x", "y", "GA", "0")], "ZIP string, `City Name` string, State string, Preferred string")
    assert [tuple(r) for r in feeds.zip_cities_of(files).collect()] == [("30301", "Atlanta City", "GA", True)]
    with pytest.raises(ValueError, match="ZIP"):
        feeds.zip_cities_of(files.select("State"))
    places = spark.createDataFrame([('{"post code":"30301","places":[{"place name":"Atlanta","state abbreviation":"ga"},{"place name":"B","state abbreviation":"GA"}]}',), ('{"post code":"10001","places":[{"place name":"NY","state abbreviation":"NY"}]}',), ('{"places":[]}',)], "doc string")
    assert [tuple(r) for r in feeds.zip_city_documents(places).collect()] == [("30301", "Atlanta", "GA")]
    assert one(spark, geo.parsed_wkt(L("POINT (1 2)"))) is None
