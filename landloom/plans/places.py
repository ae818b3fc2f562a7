"""Search, county joins and the search projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.functions.geo import centroid, covers, lat_of, lng_of, point_on_surface
from landloom.functions.normalize import clean_address, feature_id
from landloom.operators.fuzzy import similar_texts, starting_with
from landloom.operators.spatial import points_in_polygons
from landloom.sources.tables import counties, in_zip_sql, parcels, table, with_tables, zip_cities, zip_polygons

def display_address(site: Column, city: Column, zip5: Column) -> Column:
    """A site with what is known of its place; null without a site."""
    tail = F.when(city.isNotNull() & zip5.isNotNull(), F.concat(F.lit(", "), city, F.lit(", GA "), zip5)).when(city.isNotNull(), F.concat(F.lit(", "), city, F.lit(", GA"))).when(zip5.isNotNull(), F.concat(F.lit(", GA "), zip5)).otherwise("")
    return F.concat(site, tail)


def q11_parcel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active parcels with clean address, the ZIP area (with a hole and two parts) that covers the point, the least of several, and its preferred city."""
    p = parcels(spark, sf_dir).where("processed IS NULL AND objectid IS NOT NULL")
    p = p.select("id", F.round(lng_of(F.col("mx")), 9).alias("lng"), F.round(lat_of(F.col("my")), 9).alias("lat"), clean_address(F.col("site_address")).alias("site"))
    found = points_in_polygons(p.select(F.col("id").alias("parcel"), F.col("lng").alias("x"), F.col("lat").alias("y")), zip_polygons(spark, sf_dir).withColumnRenamed("zip5", "id"))
    placed = p.join(found.groupBy(F.col("parcel").alias("id")).agg(F.min("id").alias("zip5")), "id", "left")
    best = zip_cities(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("zip5").orderBy(F.desc("is_preferred"), "city"))).where("nth = 1").select("zip5", "city")
    joined = placed.join(F.broadcast(best), "zip5", "left")  # a row for each ZIP code
    return joined.select("id", F.lower("site").alias("site_norm"), "zip5", "city", display_address(F.col("site"), F.col("city"), F.col("zip5")).alias("display"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for every part name: its first words, cut so that some are prefixes and some have typos."""
    name = F.col("p_name")
    cut = F.when(F.col("p_partkey") % 3 == 0, F.substring(name, F.lit(1), F.length(name) - 2)).when(F.col("p_partkey") % 3 == 1, F.concat(F.substring(name, 2, 99), F.lit("s"))).otherwise(name)
    return table(spark, sf_dir, "part").groupBy(F.lower(cut).alias("q")).agg(F.min("p_partkey").alias("query_id"))


def ranked_search(queries: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """The k best texts of each query: exact, then prefix, then (queries of 5 characters or more) fuzzy; shorter and earlier texts first."""
    known = texts.select(F.lower("text").alias("text")).distinct()
    prefix = starting_with(queries, known).join(queries, "query_id")
    exact = prefix.select("query_id", "text", F.when(F.col("text") == F.col("q"), 0).otherwise(1).alias("stage"), F.lit(1.0).alias("similarity"))
    fuzzy = similar_texts(queries.where(F.length("q") >= 5), known).select("query_id", "text", F.lit(2).alias("stage"), "similarity")
    best = exact.unionByName(fuzzy).groupBy("query_id", "text").agg(F.min("stage").alias("stage"), F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy("stage", F.desc(F.round("similarity", 6)), F.length("text"), "text")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "text", "stage", F.round("similarity", 6).alias("similarity"))


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five part names for every query."""
    return ranked_search(search_queries(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_name").alias("text")))


def q6_county_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid of each county's outline (a box without its upper right corner), where it has one that lies inside, else a point on its surface."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    notch = F.when(F.col("county_id") % 2 == 0, 0.25).otherwise(0.9)
    cx, cy = x1 - (x1 - x0) * notch, y1 - (y1 - y0) * notch
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, cy), corner(cx, cy), corner(cx, y1), corner(x0, y1), corner(x0, y0))
    c = counties(spark, sf_dir).withColumn("ring", ring).withColumn("mid", centroid(F.col("ring"))).withColumn("on", point_on_surface(F.col("ring")))
    point = F.when(covers(F.col("ring"), F.col("mid.x"), F.col("mid.y")), F.col("mid")).otherwise(F.col("on"))
    return c.withColumn("point", point).select("county_id", "county_name", "state", F.round("point.x", 6).alias("lng"), F.round("point.y", 6).alias("lat"))


def snk8_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active parcels as GeoJSON features: outlines in degrees (six decimals) and their properties."""
    p = parcels(spark, sf_dir).where("processed IS NULL AND objectid IS NOT NULL")
    at = lambda x, y: F.array(F.format_number(lng_of(x), 6).cast("double"), F.format_number(lat_of(y), 6).cast("double"))
    x, y, s = F.col("mx"), F.col("my"), F.col("side")
    ring = F.array(at(x, y), at(x + s, y), at(x + s, y + s), at(x, y + s), at(x, y))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))
    properties = F.struct("parcel_id", F.trim("site_address").alias("site_address"), "owner_name", "owner_address", "classification")
    return p.select(feature_id(F.col("county_id"), F.col("objectid")).alias("feature_id"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


QUERIES = {f.__name__: f for f in (q11_parcel_search, text_search, q6_county_centroids, snk8_features)}
_GRAMS = lambda c: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ORACLES = {
    "q11_parcel_search": with_tables("parcels counties zip_areas zip_cities", """, p AS (SELECT id, round(degrees(mx / 6378137.0), 9) AS lng, round(degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2), 9) AS lat, nullif(trim(regexp_replace(coalesce(site_address, ''), '\\s+', ' ', 'g')), '') AS site FROM parcels WHERE processed IS NULL AND objectid IS NOT NULL),
      z AS (SELECT p.id, min(c.zip5) AS zip5 FROM p JOIN zip_areas c ON IN_ZIP GROUP BY p.id), best AS (SELECT zip5, city FROM zip_cities QUALIFY row_number() OVER (PARTITION BY zip5 ORDER BY is_preferred DESC, city) = 1)
      SELECT id, lower(site) AS site_norm, zip5, city, site || CASE WHEN city IS NOT NULL AND zip5 IS NOT NULL THEN ', ' || city || ', GA ' || zip5 WHEN city IS NOT NULL THEN ', ' || city || ', GA' WHEN zip5 IS NOT NULL THEN ', GA ' || zip5 ELSE '' END AS display FROM p LEFT JOIN z USING (id) LEFT JOIN best USING (zip5)""").replace(" , p AS", ", p AS").replace("IN_ZIP", in_zip_sql("lng", "lat")),
    "text_search": f"""WITH q AS (SELECT lower(CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, length(p_name) - 2) WHEN 1 THEN substr(p_name, 2) || 's' ELSE p_name END) AS q, min(p_partkey) AS query_id FROM part GROUP BY 1),
      t AS (SELECT DISTINCT lower(p_name) AS text FROM part), tg AS (SELECT text, {_GRAMS("text")} AS g FROM t), qg AS (SELECT query_id, q, {_GRAMS("q")} AS h FROM q),
      fuzzy AS (SELECT query_id, text, 2 AS stage, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS similarity FROM tg, qg WHERE length(q) >= 5),
      found AS (SELECT query_id, text, CASE WHEN text = q THEN 0 ELSE 1 END AS stage, 1.0::DOUBLE AS similarity FROM t JOIN q ON starts_with(text, q) UNION ALL SELECT * FROM fuzzy WHERE similarity >= 0.3),
      best AS (SELECT query_id, text, min(stage) AS stage, round(max(similarity), 6) AS similarity FROM found GROUP BY ALL)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, similarity DESC, length(text), text) AS rank, text, stage, similarity FROM best QUALIFY rank <= 5""",
    "q6_county_centroids": with_tables("counties", """, n AS (SELECT *, CASE WHEN county_id % 2 = 0 THEN 0.25 ELSE 0.9 END::DOUBLE AS f, maxx - minx AS w, maxy - miny AS h FROM counties), m AS (SELECT *, (w / 2 - f * f * w * (1 - f / 2)) / (1 - f * f) AS gx, (h / 2 - f * f * h * (1 - f / 2)) / (1 - f * f) AS gy FROM n)
      SELECT county_id, county_name, state, round(minx + CASE WHEN gx <= w - w * f OR gy <= h - h * f THEN gx WHEN f < 0.5 THEN w / 2 ELSE (w - w * f) / 2 END, 6) AS lng, round(miny + CASE WHEN gx <= w - w * f OR gy <= h - h * f THEN gy ELSE h / 2 END, 6) AS lat FROM m""").replace(" , n AS", ", n AS"),
    "snk8_features": with_tables("parcels", """, d AS (SELECT *, round(degrees(mx / 6378137.0), 6) AS x0, round(degrees((mx + side) / 6378137.0), 6) AS x1, round(degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2), 6) AS y0, round(degrees(2 * atan(exp((my + side) / 6378137.0)) - pi() / 2), 6) AS y1 FROM parcels WHERE processed IS NULL AND objectid IS NOT NULL)
      SELECT county_id::VARCHAR || '_' || objectid::VARCHAR AS feature_id, '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]]},"properties":{"parcel_id":"' || parcel_id || '"'
        || coalesce(',"site_address":"' || trim(site_address) || '"', '') || coalesce(',"owner_name":"' || owner_name || '"', '') || coalesce(',"owner_address":"' || owner_address || '"', '') || ',"classification":"' || classification || '"}}' AS feature FROM d""").replace(" , d AS", ", d AS"),
}
