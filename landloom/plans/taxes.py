"""Tax distribution, history, values and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.functions.geo import search_point, square
from landloom.functions.normalize import feature_id
from landloom.operators.filters import active, in_county, in_range, of_years, routed, tax_route, to_queue, with_ids
from landloom.operators.ranking import exact_percentiles
from landloom.operators.staging import staged
from landloom.operators.upserts import last_write_wins, upsert_columns
from landloom.plans.places import ORACLES as PLACES
from landloom.plans.places import q11_parcel_search
from landloom.sources.tables import class_codes, counties, parcel_taxes, parcels, with_tables, zip_cities


def current_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (parcel, year): the record fed last."""
    return last_write_wins(parcel_taxes(spark, sf_dir), ["parcel_id", "tax_year"], "seq").select("parcel_id", "tax_year", "tax_amount")


def taxed_parcels(spark: SparkSession, sf_dir: str, active_only: bool = False) -> DataFrame:
    p = parcels(spark, sf_dir)
    if active_only:
        p = p.where("processed IS NULL AND objectid IS NOT NULL")
    return p.join(current_taxes(spark, sf_dir).withColumnRenamed("parcel_id", "id"), "id").where("tax_amount > 0")


def q3_tax_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax distribution of every county and year."""
    rows = staged(taxed_parcels(spark, sf_dir).select("county_id", "tax_year", "tax_amount"))
    stats = rows.groupBy("county_id", "tax_year").agg(F.min("tax_amount").alias("least"), F.max("tax_amount").alias("most"), F.avg("tax_amount").alias("mean"), F.count("*").alias("n"))
    stats = stats.join(exact_percentiles(rows, ["county_id", "tax_year"], "tax_amount", [0.1, 0.5, 0.9]), ["county_id", "tax_year"])
    rounded = lambda c: F.round(c, 7)
    return stats.select("county_id", "tax_year", "least", "most", rounded(F.col("mean")).alias("mean"), rounded(F.col("p")[0]).alias("p10"), rounded(F.col("p")[1]).alias("p50"), rounded(F.col("p")[2]).alias("p90"), "n")


def q1_parcel_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active parcels with county, class, search point and the address that the search shows."""
    p = active(parcels(spark, sf_dir)).withColumn("point", search_point(square(F.col("mx"), F.col("my"), F.col("side"))))
    shown = q11_parcel_search(spark, sf_dir).select("id", F.col("display").alias("display_address"))
    joined = p.join(counties(spark, sf_dir).select("county_id", "county_name", "state"), "county_id").join(class_codes(spark, sf_dir).withColumnRenamed("code", "classification"), ["county_id", "classification"], "left").join(shown, "id", "left")
    return joined.select(
        feature_id(F.col("county_id"), F.col("objectid")).alias("feature_id"), "parcel_id", "county_name", "state", "category", F.coalesce("is_residential", F.lit(False)).alias("is_residential"),
        "display_address", F.round("point.lat", 7).alias("search_lat"), F.round("point.lng", 7).alias("search_lng"),
    )


def agg7_county_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years with taxes of each county, before amounts are looked at."""
    return parcels(spark, sf_dir).select("id", "county_id").join(parcel_taxes(spark, sf_dir).select(F.col("parcel_id").alias("id"), "tax_year").distinct(), "id").select("county_id", "tax_year").distinct()


def q4_values_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes of asked parcels (ids divisible by 100) of two years that lie between two amounts, in all counties."""
    p = with_ids(in_county(active(parcels(spark, sf_dir))), parcels(spark, sf_dir).where("id % 100 = 0"), "id")
    rows = p.select("id", "objectid").join(of_years(current_taxes(spark, sf_dir), [1995, 1996]).withColumnRenamed("parcel_id", "id"), "id")
    return in_range(rows, "tax_amount", 200, 2500).select("objectid", "tax_year", "tax_amount")


def flt12_tax_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels to be asked of each tax provider by county, and those of counties without a known provider."""
    numbered = parcels(spark, sf_dir).withColumn("parcel_id", F.when(F.col("id") % 61 == 0, F.concat(F.lit("County-"), "parcel_id")).when(F.col("id") % 59 != 0, F.col("parcel_id")).otherwise(""))
    providers = counties(spark, sf_dir).withColumn("provider", F.when(F.col("county_id") % 4 < 2, "GovWindow").when(F.col("county_id") % 4 == 2, "Wildfire").when(F.col("county_id") % 8 == 3, "Other"))
    known, unknown = routed(to_queue(numbered), providers, tax_route(F.col("provider")))
    return known.unionByName(unknown.withColumn("route", F.lit("unknown"))).groupBy("county_id", "route").agg(F.count("*").alias("n"))


def jn18_missing_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP codes of owners' addresses that the lookup has no city for, with the parcels that wait for it."""
    asked = parcels(spark, sf_dir).select(F.regexp_extract(F.coalesce("owner_address", F.lit("")), r"(\d{5})$", 1).alias("zip5")).where("zip5 <> ''").groupBy("zip5").agg(F.count("*").alias("n"))
    return asked.join(zip_cities(spark, sf_dir).select("zip5"), "zip5", "left_anti")


def q2_tax_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly taxes of each parcel, newest first, with the change and the position between the parcel's least and most."""
    own, by_year = Window.partitionBy("parcel_id"), Window.partitionBy("parcel_id").orderBy("tax_year")
    low, high = F.min("tax_amount").over(own), F.max("tax_amount").over(own)
    return current_taxes(spark, sf_dir).select(
        "parcel_id", "tax_year", "tax_amount", F.row_number().over(Window.partitionBy("parcel_id").orderBy(F.desc("tax_year"))).alias("nth"),
        F.round(F.col("tax_amount") - F.lag("tax_amount").over(by_year), 4).alias("change"), F.round(F.when(high > low, (F.col("tax_amount") - low) / (high - low)).otherwise(0.5), 6).alias("position"),
    )


#: Stops of the colour scale where a county's own are degenerate.
STOPS = (0.0, 1000.0, 3000.0, 6000.0, 10000.0)


def color_scale(value: Column, stops: list[Column]) -> Column:
    """class (0 to 3: between which two of the five stops a value lies) and weight (its place between them, 0 to 1); fixed stops where the own do not rise."""
    rising = stops[0] < stops[1]
    for low, high in zip(stops[1:], stops[2:], strict=False):
        rising = rising & (low < high)
    s = [F.when(rising, own).otherwise(fixed) for own, fixed in zip(stops, STOPS, strict=True)]
    number = F.when(value < s[1], 0).when(value < s[2], 1).when(value < s[3], 2).otherwise(3)
    low, high = (F.element_at(F.array(*side), number + 1) for side in (s[:-1], s[1:]))
    return F.struct(number.alias("class"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))).alias("weight"))


def q4_tax_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest tax of each active parcel with its place on its county's colour scale of that year."""
    newest = taxed_parcels(spark, sf_dir, True).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("tax_year")))).where("nth = 1")
    stats = F.broadcast(q3_tax_stats(spark, sf_dir).select("county_id", "tax_year", "least", "p10", "p50", "p90", "most"))  # a row for each county and year
    scale = color_scale(F.col("tax_amount"), [F.col(c) for c in ("least", "p10", "p50", "p90", "most")])
    return newest.join(stats, ["county_id", "tax_year"]).withColumn("scale", scale).select("id", "county_id", "tax_year", "tax_amount", F.col("scale.class").alias("color_class"), F.round("scale.weight", 6).alias("weight"))


def agg11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active, failed and taxed parcels of each county and in all."""
    taxed = current_taxes(spark, sf_dir).select(F.col("parcel_id").alias("id")).distinct().withColumn("taxed", F.lit(True))
    joined = parcels(spark, sf_dir).join(taxed, "id", "left")
    return joined.rollup("county_id").agg(F.count("*").alias("n"), F.count_if(F.col("processed").isNull()).alias("active"), F.count_if(~F.col("processed")).alias("failed"), F.count_if("taxed").alias("taxed"), F.round(100 * F.count_if("taxed") / F.count("*"), 2).alias("percent"))


def snk2_tax_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old taxes (records with an even seq) updated by new ones (odd): amounts come from the new, the first seq stays."""
    all_ = parcel_taxes(spark, sf_dir)
    old, new = (last_write_wins(all_.where(F.col("seq") % 2 == i), ["parcel_id", "tax_year"], "seq") for i in (0, 1))
    return upsert_columns(old, new, ["parcel_id", "tax_year"], ["tax_amount"])


def agg9_changed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ from the one before of the same parcel and year."""
    before = F.lag("tax_amount").over(Window.partitionBy("parcel_id", "tax_year").orderBy("seq"))
    return parcel_taxes(spark, sf_dir).withColumn("before", before).where("before IS NULL OR before <> tax_amount").select("parcel_id", "tax_year", "seq", "tax_amount")


QUERIES = {f.__name__: f for f in (q3_tax_stats, q1_parcel_details, q2_tax_history, q4_tax_values, agg11_coverage, snk2_tax_upsert, agg9_changed_records, agg7_county_years, q4_values_of_ids, flt12_tax_queues, jn18_missing_zips)}
_STATS = """stats AS (SELECT county_id, tax_year, min(tax_amount) AS least, max(tax_amount) AS most, round(avg(tax_amount), 7) AS mean, round(quantile_cont(tax_amount, 0.1), 7) AS p10,
  round(quantile_cont(tax_amount, 0.5), 7) AS p50, round(quantile_cont(tax_amount, 0.9), 7) AS p90, count(*) AS n FROM parcels JOIN taxes ON id = taxes.parcel_id WHERE tax_amount > 0 GROUP BY ALL)"""
ORACLES = {
    "q3_tax_stats": with_tables("parcels parcel_taxes taxes", f", {_STATS} SELECT * FROM stats").replace(" , stats", ", stats"),
    "q1_parcel_details": with_tables("parcels counties class_codes", f""", shown AS ({PLACES["q11_parcel_search"]}) SELECT parcels.county_id::VARCHAR || '_' || objectid::VARCHAR AS feature_id, parcel_id, county_name, state, category, coalesce(is_residential, false) AS is_residential,
      display AS display_address, round(degrees(2 * atan(exp((my + side / 2) / 6378137.0)) - pi() / 2), 7) AS search_lat, round(degrees((mx + side / 2) / 6378137.0), 7) AS search_lng
      FROM parcels JOIN counties ON counties.county_id = parcels.county_id LEFT JOIN class_codes ON code = classification AND class_codes.county_id = parcels.county_id LEFT JOIN shown ON shown.id = parcels.id WHERE processed IS NULL AND objectid IS NOT NULL""").replace(" , shown", ", shown"),
    "agg7_county_years": with_tables("parcels parcel_taxes", "SELECT DISTINCT county_id, tax_year FROM parcels JOIN parcel_taxes ON parcels.id = parcel_taxes.parcel_id"),
    "q4_values_of_ids": with_tables("parcels parcel_taxes taxes", "SELECT objectid, tax_year, tax_amount FROM parcels JOIN taxes ON taxes.parcel_id = parcels.id WHERE processed IS NULL AND objectid IS NOT NULL AND id % 100 = 0 AND tax_year IN (1995, 1996) AND tax_amount BETWEEN 200 AND 2500"),
    "flt12_tax_queues": with_tables("parcels", "SELECT county_id, CASE WHEN county_id % 4 < 2 THEN 'GovWindow' WHEN county_id % 4 = 2 THEN 'Wildfire' ELSE 'unknown' END AS route, count(*) AS n FROM parcels WHERE id % 61 <> 0 AND id % 59 <> 0 GROUP BY ALL"),
    "jn18_missing_zips": with_tables("parcels zip_cities", "SELECT zip5, count(*) AS n FROM (SELECT regexp_extract(coalesce(owner_address, ''), '([0-9]{5})$', 1) AS zip5 FROM parcels) WHERE zip5 <> '' AND zip5 NOT IN (SELECT zip5 FROM zip_cities) GROUP BY zip5"),
    "q2_tax_history": with_tables("parcel_taxes taxes", """SELECT parcel_id, tax_year, tax_amount, row_number() OVER (PARTITION BY parcel_id ORDER BY tax_year DESC) AS nth, round(tax_amount - lag(tax_amount) OVER (PARTITION BY parcel_id ORDER BY tax_year), 4) AS change,
      round(CASE WHEN max(tax_amount) OVER w > min(tax_amount) OVER w THEN (tax_amount - min(tax_amount) OVER w) / (max(tax_amount) OVER w - min(tax_amount) OVER w) ELSE 0.5 END, 6) AS position FROM taxes WINDOW w AS (PARTITION BY parcel_id)"""),
    "q4_tax_values": with_tables("parcels parcel_taxes taxes", f""", {_STATS}, newest AS (SELECT id, county_id, tax_year, tax_amount FROM parcels JOIN taxes ON id = taxes.parcel_id WHERE tax_amount > 0 AND processed IS NULL AND objectid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tax_year DESC) = 1)
      SELECT id, county_id, tax_year, tax_amount, CASE WHEN tax_amount < s[2] THEN 0 WHEN tax_amount < s[3] THEN 1 WHEN tax_amount < s[4] THEN 2 ELSE 3 END AS color_class,
        round(greatest(0, least(1, (tax_amount - s[color_class + 1]) / (s[color_class + 2] - s[color_class + 1]))), 6)::DOUBLE AS weight
      FROM (SELECT *, CASE WHEN least < p10 AND p10 < p50 AND p50 < p90 AND p90 < most THEN [least, p10, p50, p90, most] ELSE [0, 1000, 3000, 6000, 10000]::DOUBLE[] END AS s FROM newest JOIN stats USING (county_id, tax_year))""").replace(" , stats", ", stats"),
    "agg11_coverage": with_tables("parcels parcel_taxes", """SELECT county_id, count(*) AS n, count(*) FILTER (processed IS NULL) AS active, count(*) FILTER (NOT processed) AS failed, count(*) FILTER (taxed) AS taxed, round(100 * count(*) FILTER (taxed) / count(*), 2) AS percent
      FROM (SELECT p.*, t.id IS NOT NULL AS taxed FROM parcels p LEFT JOIN (SELECT DISTINCT parcel_id AS id FROM parcel_taxes) t USING (id)) GROUP BY ROLLUP (county_id)"""),
    "snk2_tax_upsert": with_tables("parcel_taxes", """, o AS (SELECT * FROM parcel_taxes WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY parcel_id, tax_year ORDER BY seq DESC) = 1), n AS (SELECT * FROM parcel_taxes WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY parcel_id, tax_year ORDER BY seq DESC) = 1)
      SELECT parcel_id, tax_year, coalesce(n.tax_amount, o.tax_amount) AS tax_amount, coalesce(o.seq, n.seq) AS seq FROM o FULL JOIN n USING (parcel_id, tax_year)""").replace(" , o AS", ", o AS"),
    "agg9_changed_records": with_tables("parcel_taxes", "SELECT parcel_id, tax_year, seq, tax_amount FROM (SELECT *, lag(tax_amount) OVER (PARTITION BY parcel_id, tax_year ORDER BY seq) AS before FROM parcel_taxes) WHERE before IS NULL OR before <> tax_amount"),
}
