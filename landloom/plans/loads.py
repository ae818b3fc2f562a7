"""Loads of feeds: parcels, taxes, ZIP codes and counties. The feeds are written by Spark from the driver's tables and parsed as they would arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.functions.geo import area, bbox, centroid_of
from landloom.functions.mapping import FieldMapping, mapped_parcels
from landloom.functions.normalize import html_acres, html_owner, merged_district, money, owner_block, site_number
from landloom.operators.staging import staged
from landloom.operators.topology import simplified_rings
from landloom.operators.upserts import insert_ignore, last_write_wins, update_non_empty
from landloom.sources import feeds
from landloom.sources.tables import counties, parcels, table, with_tables, zip_cities

#: Features of a document; fixed value: degrees by which a county's simplified outline may differ.
DOCUMENT, COUNTY_TOLERANCE = 20, 0.005

EVEN = [
    FieldMapping("PARCEL_NO", "parcel_id", "TRIM"), FieldMapping("OBJECTID", "objectid"), FieldMapping("OWNER", "owner_name", "UPPER"), FieldMapping("ADDR,CITY,STATE,ZIP", "owner_address", "CONCAT_ADDRESS"),
    FieldMapping("SITE", "site_address", "REPLACE(Street,St)"), FieldMapping("SITE", "site_number", "EXTRACT_SITE_NUMBER"), FieldMapping("SHAPE_Area", "acres"), FieldMapping("CLASS", "classification", "LOWER()"),
]
ODD = [
    FieldMapping("PIN", "parcel_id"), FieldMapping("FID", "objectid"), FieldMapping("NAME1,NAME2", "owner_name", "CONCAT"), FieldMapping("SITE", "site_address", "TRIM()"),
    FieldMapping("$GEOMETRY", "acres", "CALC_FROM_GEOMETRY"), FieldMapping("CLASS", "classification"), FieldMapping("ZONE", "tax_district"),
]
MAPPINGS = {county: ODD if county % 2 else EVEN for county in range(25)}


def _documents(rows: DataFrame, group: list[str], item: str, head: str) -> DataFrame:
    """One document for each group, of the items (JSON texts) in it."""
    return rows.groupBy(*group).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]}")).alias("doc"))


def _ring(scale: float = 1) -> Column:
    x, y, s = F.col("mx"), F.col("my"), F.col("side") * scale
    return F.array(*[F.array(a, b) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))])


def parcel_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """county_id, seq, doc: GeoJSON of the counties with even ids, Esri JSON of the others; every tenth parcel comes again, with another site, in a later document."""
    k = F.col("id")
    p = parcels(spark, sf_dir)
    p = p.withColumn("seq", F.lit(1)).unionByName(p.where(k % 10 == 0).withColumn("site_address", F.concat(F.lit("7 Updated Street "), k.cast("string"))).withColumn("seq", F.lit(2)))
    number = F.when(k % 83 != 0, F.concat(F.lit(" "), F.col("parcel_id")))
    even = F.struct(
        number.alias("PARCEL_NO"), F.col("objectid").alias("OBJECTID"), F.lower("owner_name").alias("OWNER"), F.when(k % 37 != 0, F.concat((k % 60).cast("string"), F.lit(" OAK"))).alias("ADDR"),
        F.when(k % 29 != 0, F.lit("MACON")).otherwise("").alias("CITY"), F.lit("GA").alias("STATE"), (30000 + k % 25).cast("string").alias("ZIP"), F.col("site_address").alias("SITE"),
        (F.col("side") * F.col("side") * 10).alias("SHAPE_Area"), F.col("classification").alias("CLASS"),
    )
    odd = F.struct(F.when(k % 83 != 0, F.col("parcel_id")).otherwise("").alias("PIN"), F.col("objectid").alias("FID"), F.col("owner_name").alias("NAME1"), F.when(k % 2 == 0, "& CO").alias("NAME2"), F.col("site_address").alias("SITE"), F.col("classification").alias("CLASS"), F.concat(F.lit("Z"), (k % 5).cast("string")).alias("ZONE"))
    geojson = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(_ring()).alias("coordinates")).alias("geometry"), even.alias("properties")))
    esri = F.to_json(F.struct(odd.alias("attributes"), F.struct(F.array(_ring()).alias("rings")).alias("geometry")))
    rows = p.select("county_id", "seq", F.floor(k / DOCUMENT).alias("part"), F.when(F.col("county_id") % 2 == 0, geojson).otherwise(esri).alias("item"))
    return _documents(rows, ["county_id", "seq", "part"], "item", '{"features":[').drop("part")


def load_parcels(docs: DataFrame, mappings: dict[int, list[FieldMapping]]) -> DataFrame:
    """Parcels of feature documents (county_id, seq, doc): mapped, checked, and the last write of each (county, objectid)."""
    return last_write_wins(mapped_parcels(feeds.features(docs), mappings), ["county_id", "objectid"], "seq").drop("seq")


def q17_load_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of the feeds of all counties, with the lower left corner of their geometry."""
    loaded = load_parcels(parcel_documents(spark, sf_dir), MAPPINGS)
    return loaded.withColumn("box", bbox(F.col("geom"))).select("county_id", "parcel_id", "objectid", "owner_name", "owner_address", "site_address", "site_number", "acres", "classification", "tax_district", "processed", "error_message", F.col("box.minx").alias("minx"), F.col("box.miny").alias("miny"))


def q18_load_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of WKT documents that are not yet in the table (ids that 4 divides are), numbered within their county by key."""
    k = F.col("id")
    corner = lambda dx, dy: F.concat((F.col("mx") + dx).cast("long").cast("string"), F.lit(" "), (F.col("my") + dy).cast("long").cast("string"))
    s = F.col("side")
    wkt = F.concat(F.lit("POLYGON (("), corner(0, 0), F.lit(", "), corner(s, 0), F.lit(", "), corner(s, s), F.lit(", "), corner(0, s), F.lit(", "), corner(0, 0), F.lit("))"))
    html = F.concat(F.lit("<b>Owner</b> - "), F.coalesce("owner_name", F.lit("")), F.lit(" <br><b>Acres</b> - "), F.when(k % 9 == 0, "n/a").otherwise((k % 70 / 8).cast("string")), F.lit("<br>"))
    p = parcels(spark, sf_dir)
    item = F.to_json(F.struct(F.when(k % 31 != 0, F.col("parcel_id")).otherwise("").alias("Key"), wkt.alias("WktGeometry"), F.trim("site_address").alias("Address"), html.alias("ResultHtml")))
    rows = p.select("county_id", F.floor(k / DOCUMENT).alias("part"), item.alias("item"))
    docs = _documents(rows.union(rows.where(F.col("part") % 3 == 0)), ["county_id", "part"], "item", '{"d":[').drop("part")
    f = feeds.wkt_features(docs).withColumn("objectid", F.row_number().over(Window.partitionBy("county_id").orderBy("key", "wkt")))
    box = bbox(F.col("geom"))
    new = f.select("county_id", F.col("key").alias("parcel_id"), "objectid", F.col("address").alias("site_address"), site_number(F.coalesce("address", F.lit(""))).alias("site_number"), html_owner(F.col("html")).alias("owner_name"), html_acres(F.col("html")).alias("acres"), box["minx"].alias("minx"), box["maxy"].alias("maxy"))
    old = p.where(k % 4 == 0).select("county_id", "parcel_id", F.lit(0).alias("objectid"), F.lit("old").alias("site_address"), F.lit("").alias("site_number"), F.lit("old").alias("owner_name"), F.lit(0.0).alias("acres"), F.lit(0.0).alias("minx"), F.lit(0.0).alias("maxy"))
    return insert_ignore(old, new, ["county_id", "parcel_id"])


def q19_enrich_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with what their detail pages tell: address, owner, class and district, where not empty."""
    k = F.col("id")
    p = parcels(spark, sf_dir).withColumn("tax_district", F.lit("OLD"))
    site = F.trim("site_address")
    cell = lambda label, value: F.concat(F.lit(f"<tr><td><strong>{label}&nbsp;</strong></td> <td class='v'> "), F.coalesce(value, F.lit("")), F.lit(" </td></tr>"))
    second = F.when(k % 3 == 0, F.concat(F.upper(site), F.lit("<br/>MACON, GA 31201"))).when(k % 3 == 1, F.concat(F.lit("P.O. BOX "), (k % 50).cast("string"), F.lit("<br>MACON"))).otherwise("NO ADDRESS")
    page = F.concat(cell("Physical Address", site), cell("Owner", F.concat(F.coalesce("owner_name", F.lit("")), F.lit(" <BR> "), F.coalesce(second, F.lit("")))), cell("Class Code", F.when(k % 7 != 0, "R3")), cell("Tax District", F.when(k % 5 != 0, F.concat(F.lit("D"), (k % 5).cast("string")))))
    told = p.select("county_id", "parcel_id", feeds.detail_fields(page).alias("f"))
    told = told.select("county_id", "parcel_id", "f.*", owner_block(F.col("f.owner_block"), F.col("f.physical_address")).alias("o"))
    new = told.select("county_id", "parcel_id", F.col("physical_address").alias("site_address"), F.col("o.name").alias("owner_name"), F.col("o.address").alias("owner_address"), F.col("class_code").alias("classification"), "tax_district")
    columns = ["site_address", "owner_name", "owner_address", "classification", "tax_district"]
    return update_non_empty(p.select("county_id", "parcel_id", *columns), new, ["county_id", "parcel_id"], columns)


def load_taxes_json(docs: DataFrame) -> DataFrame:
    """parcel_id, tax_year, tax_amount, appraised, assessed, millage (a fraction), payer_name and district of tax documents (parcel_id, doc).

    A record with the base tax of the one before it of its year is skipped; of the others the last stands. district: the last one told that is not empty.
    """
    by_year = Window.partitionBy("parcel_id", "tax_year").orderBy("pos")
    kept = feeds.tax_records(docs).withColumn("before", F.lag("base_tax").over(by_year)).where("before IS NULL OR before <> base_tax")
    kept = kept.withColumn("told", F.max(F.when(F.col("district") != "", F.struct("pos", "district"))).over(Window.partitionBy("parcel_id"))["district"])
    last = kept.withColumn("nth", F.row_number().over(Window.partitionBy("parcel_id", "tax_year").orderBy(F.desc("pos")))).where("nth = 1")
    return last.select("parcel_id", "tax_year", F.col("base_tax").alias("tax_amount"), "appraised", "assessed", F.when(F.col("assessed") > 0, F.col("base_tax") / F.col("assessed")).otherwise(0.0).alias("millage"), "payer_name", F.col("told").alias("district"))


def q20_load_taxes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes of each parcel's document, with its district merged into the one it had."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    tax = F.col("o_totalprice") / 100
    of = lambda n: F.struct((o * 2 + n).alias("at"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("0"), (k % 4).cast("string"), F.when(o % 2 == 0, "A").otherwise(""))).alias("District"), F.year("o_orderdate").alias("Year"), F.struct((tax * 25).alias("Appraised"), F.when(o % 17 == 0, 0.0).otherwise(tax * 10).alias("Assessed"), (tax + (n if n else 0)).alias("BaseTax")).alias("Values"), F.struct(F.lit("PAID").alias("Status"), F.concat(F.lit("P"), o.cast("string")).alias("PayerName")).alias("Payment"))
    again = F.when(o % 5 == 0, F.array(of(0), of(0).withField("at", o * 2 + 1))).when(o % 7 == 0, F.array(of(0), of(1))).otherwise(F.array(of(0)))
    rows = table(spark, sf_dir, "orders").select(k.alias("parcel_id"), F.explode(again).alias("r"))
    docs = rows.groupBy("parcel_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["District"].alias("District"), r["Year"].alias("Year"), r["Values"].alias("Values"), r["Payment"].alias("Payment"))).alias("Records"))).alias("doc"))
    old = F.when(F.col("parcel_id") % 3 == 0, F.concat(F.lit("0"), (F.col("parcel_id") % 4).cast("string"))).when(F.col("parcel_id") % 3 == 1, "X")
    return load_taxes_json(docs).withColumn("district", merged_district(old, F.col("district")))


BILL_SITE = "https://bills.example.org"


def load_taxes_html(lists: DataFrame, bills: DataFrame) -> DataFrame:
    """One row for each listed bill: lists (parcel_id, doc) are pages of links, bills (url, doc) their pages; the last bill number of a (parcel, year) stands."""
    links = feeds.bill_links(lists, BILL_SITE)
    told = links.join(bills.select("url", feeds.bill_fields(F.col("doc")).alias("f")), "url").select("parcel_id", "tax_year", "bill_no", "url", "f.*")
    fair, tax = money(F.col("fair_market_value")), money(F.col("tax_amount"))
    assessed = fair * 0.40
    rows = told.select(
        "parcel_id", "tax_year", "bill_no", F.col("url").alias("bill_url"), "payer_name", "due_date", "paid_date", tax.alias("tax_amount"), fair.alias("appraised"), assessed.alias("assessed"),
        F.when(assessed > 0, tax / assessed * 1000).otherwise(0.0).alias("millage"), money(F.col("building_value")).alias("building_value"), money(F.col("land_value")).alias("land_value"), money(F.col("total_due")).alias("total_due"), money(F.col("back_taxes")).alias("back_taxes"),
    )
    return last_write_wins(rows, ["parcel_id", "tax_year"], "bill_no")


def q21_load_taxes_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes of bill pages made of the orders, twenty years on."""
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate") + 20).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")).withColumn("bill", F.lpad(o.cast("string"), 12, "0"))
    href = F.concat(F.when(o % 2 == 0, BILL_SITE).otherwise(""), F.lit("/bill?bill_id="), o.cast("string"))
    row = F.concat(F.lit('<tr><td class="tax_year"> '), F.col("year").cast("string"), F.lit(' </td><td class="tax_map_type x">'), F.when(o % 4 == 0, "Personal").otherwise(" Real"), F.lit('</td><td class="tax_bill_no"><a href="'), href, F.lit('">'), F.col("bill"), F.lit("</a></td></tr>"))
    lists = orders.groupBy(F.col("o_custkey").alias("parcel_id")).agg(F.concat(F.lit('<html><table id="tbl_tax_results"><tbody>'), F.array_join(F.collect_list(row), "\n"), F.lit("</tbody></table></html>")).alias("doc"))
    dollars = lambda cents: F.concat(F.lit("$"), F.format_number(F.floor(cents / 100), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    cents = F.col("cents")
    labelled = lambda label, css, value: F.concat(F.lit(f'<td class="{css}" data-label="{label}"> '), value, F.lit(" </td>"))
    line = lambda label, value: F.concat(F.lit(f"<tr><td>{label}</td><td> "), value, F.lit("</td></tr>"))
    page = F.concat(
        F.lit('<table id="tbl_temp"><tr>'), labelled("Tax Payer:", "a", F.concat(F.lit("PAYER <b>"), F.col("o_custkey").cast("string"), F.lit("</b>"))), F.lit('</tr></table><table id="tbl_tax_bill_item"><tr>'),
        labelled("Building Value:", "tax_item_building_value", dollars(cents * 3)), labelled("Land Value:", "tax_item_land_value", F.concat(F.lit("("), dollars(cents), F.lit(")"))),
        labelled("Fair Market Value:", "tax_item_f_m_value", F.when(o % 13 == 0, "n/a").otherwise(dollars(cents * 4))), labelled("Due Date:", "tax_item_due_date", F.lit("12/20")), F.lit('</tr></table><table class="t tbl_tax_detail_sumary">'),
        line("<strong>Current Due</strong>", dollars(F.floor(cents / 25))), line("Back Taxes", F.lit("$0.00")), line("<strong> Total Due </strong>", dollars(F.floor(cents / 20))), line("Paid Date", F.lit("11/02")), F.lit("</table>"),
    )
    bills = orders.select(F.concat(F.lit(f"{BILL_SITE}/bill?bill_id="), o.cast("string")).alias("url"), page.alias("doc"))
    return load_taxes_html(lists, bills)


def q22_zip_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP areas of GeoJSON documents with the cities of a file whose headers vary."""
    c = counties(spark, sf_dir)
    code = (30000 + F.col("county_id")).cast("string")
    i = F.col("county_id")
    name = F.when(i % 3 == 0, F.create_map(F.lit("ZIP"), code)).when(i % 3 == 1, F.create_map(F.lit("ZCTA5CE20"), F.concat(code, F.lit("-0001")))).otherwise(F.create_map(F.lit("NAME"), code))
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    docs = c.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), name.alias("properties"))).alias("features"))).alias("doc"))
    areas = feeds.zip_areas(docs).withColumn("box", bbox(F.col("geom")))
    file = zip_cities(spark, sf_dir).select(F.concat(F.lit(" "), F.col("zip5")).alias("Zip Code"), F.upper("city").alias("City Name"), F.lit("ga").alias("STATE"), F.when(F.col("is_preferred"), "Yes").otherwise("0").alias("is_preferred"))
    return areas.join(feeds.zip_cities_of(file), "zip5", "left").select("zip5", "city", "state", "is_preferred", F.col("box.minx").alias("minx"), F.col("box.maxy").alias("maxy"))


def q23_load_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties of documents with one feature, with box, centroid and what is left of their outline (sides with a shallow bay each) at a tolerance of 0.005 degrees."""
    c, i = counties(spark, sf_dir), F.col("county_id")
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    midx, midy, bay = (x0 + x1) / 2, (y0 + y1) / 2, 0.002
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (midx, y0 + bay), (x1, y0), (x1 - bay, midy), (x1, y1), (midx, y1 - bay), (x0, y1), (x0 + bay, midy), (x0, y0))])
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.col("county_name").alias("NAME10"), (i * 100).alias("totpop10"), F.when(i % 4 == 0, "").otherwise("R").alias("Reg_Comm"), (i * 2.5).alias("Acres"), (i % 3 * 1.5).alias("Sq_Miles")).alias("properties"))
    docs = c.select(F.to_json(F.struct(F.when(i % 11 == 10, F.array(feature, feature)).otherwise(F.array(feature)).alias("features"))).alias("doc"))
    f = feeds.county_features(docs).withColumn("box", bbox(F.col("geom"))).withColumn("mid", centroid_of(F.col("geom")))
    f = staged(f)
    thin = simplified_rings(f.select(F.col("name").alias("id"), "geom"), COUNTY_TOLERANCE).select(F.col("id").alias("name"), F.size(F.col("geom")[0][0]).cast("long").alias("simplified_points"), F.round(area(F.col("geom")), 6).alias("simplified_area"))
    return f.join(thin, "name", "left").select("name", "population", "region", "acres", "square_miles", "box.*", F.round("mid.x", 6).alias("lng"), F.round("mid.y", 6).alias("lat"), "simplified_points", "simplified_area")


QUERIES = {f.__name__: f for f in (q17_load_parcels, q18_load_wkt, q19_enrich_parcels, q20_load_taxes_json, q21_load_taxes_html, q22_zip_reference, q23_load_counties)}
_STRIP = lambda y: f"((1 - pow(0.0818191908426215, 2)) * (sin({y}) / (1 - pow(0.0818191908426215 * sin({y}), 2)) - ln((1 - 0.0818191908426215 * sin({y})) / (1 + 0.0818191908426215 * sin({y}))) / (2 * 0.0818191908426215)))"
_LAT = lambda y: f"(2 * atan(exp(({y}) / 6378137.0)) - pi() / 2)"
ORACLES = {
    "q17_load_parcels": with_tables("parcels", f""", f AS (SELECT *, 1 AS seq FROM parcels UNION ALL SELECT * REPLACE ('7 Updated Street ' || id AS site_address), 2 FROM parcels WHERE id % 10 = 0),
      m AS (SELECT county_id, county_id % 2 = 0 AS even, seq, objectid, mx AS minx, my AS miny, CASE WHEN id % 83 = 0 THEN CASE WHEN county_id % 2 = 0 THEN NULL ELSE '' END ELSE parcel_id END AS parcel_id,
        CASE WHEN county_id % 2 = 0 THEN nullif(upper(owner_name), '') WHEN owner_name IS NULL AND id % 2 = 1 THEN NULL ELSE nullif(array_to_string(list_filter([trim(owner_name), CASE WHEN id % 2 = 0 THEN '& CO' END], lambda x: x <> ''), ' '), '') END AS owner_name,
        CASE WHEN county_id % 2 = 1 THEN NULL WHEN id % 37 = 0 THEN CASE WHEN id % 29 = 0 THEN '' ELSE 'MACON' END || '|GA|' || (30000 + id % 25) WHEN id % 29 = 0 THEN 'GA ' || (30000 + id % 25) ELSE (id % 60) || ' OAK, MACON, GA ' || (30000 + id % 25) END AS owner_address,
        CASE WHEN county_id % 2 = 0 THEN replace(site_address, 'Street', 'St') ELSE trim(site_address) END AS site_address, CASE WHEN county_id % 2 = 0 THEN string_split(trim(site_address), ' ')[1] END AS site_number,
        CASE WHEN county_id % 2 = 0 THEN floor(side * side * 10 / 43560.0 * 100 + 0.5) / 100 ELSE round(side / 6378137.0 * ({_STRIP(_LAT("my + side"))} - {_STRIP(_LAT("my"))}) * (pow(6378137.0, 2) / 2) / 4046.86, 2) END AS acres,
        CASE WHEN county_id % 2 = 0 THEN lower(classification) ELSE classification END AS classification, CASE WHEN county_id % 2 = 1 THEN 'Z' || (id % 5) END AS tax_district, id FROM f),
      l AS (SELECT * FROM m WHERE objectid IS NULL UNION ALL (SELECT * FROM m WHERE objectid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY county_id, objectid ORDER BY seq DESC) = 1))
      SELECT county_id, parcel_id, objectid, owner_name, owner_address, site_address, site_number, acres, classification, tax_district, CASE WHEN coalesce(parcel_id, '') = '' THEN false END AS processed, CASE WHEN coalesce(parcel_id, '') = '' THEN 'missing required field: parcel_id' END AS error_message, minx, miny FROM l""").replace(" , f AS", ", f AS"),
    "q18_load_wkt": with_tables("parcels", """, new AS (SELECT county_id, parcel_id, row_number() OVER (PARTITION BY county_id ORDER BY parcel_id) AS objectid, trim(site_address) AS site_address, coalesce(string_split(trim(site_address), ' ')[1], '') AS site_number, trim(coalesce(owner_name, '')) AS owner_name, CASE WHEN id % 9 = 0 THEN 0.0 ELSE (id % 70) / 8 END AS acres, mx AS minx, my + side AS maxy FROM parcels WHERE id % 31 <> 0)
      SELECT county_id, parcel_id, 0 AS objectid, 'old' AS site_address, '' AS site_number, 'old' AS owner_name, 0.0::DOUBLE AS acres, 0.0::DOUBLE AS minx, 0.0::DOUBLE AS maxy FROM parcels WHERE id % 4 = 0 UNION ALL SELECT * FROM new WHERE parcel_id NOT IN (SELECT parcel_id FROM parcels WHERE id % 4 = 0)""").replace(" , new", ", new"),
    "q19_enrich_parcels": with_tables("parcels", """, e AS (SELECT *, trim(coalesce(site_address, '')) AS site, trim(coalesce(owner_name, '')) AS own, CASE WHEN id % 3 = 0 THEN upper(trim(site_address)) || ' MACON, GA 31201' WHEN id % 3 = 1 THEN 'P.O. BOX ' || (id % 50) || ' MACON' END AS mail FROM parcels)
      SELECT county_id, parcel_id, CASE WHEN site <> '' THEN site ELSE site_address END AS site_address,
        CASE WHEN id % 3 = 2 THEN nullif(trim(own || ' NO ADDRESS'), '') WHEN own <> '' THEN own ELSE owner_name END AS owner_name, coalesce(mail, owner_address) AS owner_address,
        CASE WHEN id % 7 <> 0 THEN 'R3' ELSE classification END AS classification, CASE WHEN id % 5 <> 0 THEN 'D' || (id % 5) ELSE 'OLD' END AS tax_district FROM e""").replace(" , e AS", ", e AS"),
    "q20_load_taxes_json": """WITH r AS (SELECT o_custkey AS parcel_id, year(o_orderdate)::INT AS tax_year, o_orderkey AS o, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [0, 2] WHEN o_orderkey % 7 = 0 THEN [0, 1] ELSE [0] END) AS n, o_totalprice / 100 AS tax FROM orders),
      s AS (SELECT parcel_id, tax_year, o * 2 + least(n, 1) AS pos, o, tax, tax + (n % 2) AS base, CASE WHEN o % 3 = 0 THEN '' ELSE '0' || (parcel_id % 4) || CASE WHEN o % 2 = 0 THEN 'A' ELSE '' END END AS district FROM r),
      k AS (SELECT * FROM s QUALIFY coalesce(lag(base) OVER (PARTITION BY parcel_id, tax_year ORDER BY pos) <> base, true)),
      d AS (SELECT parcel_id, arg_max(district, pos) FILTER (district <> '') AS new, CASE parcel_id % 3 WHEN 0 THEN '0' || (parcel_id % 4) WHEN 1 THEN 'X' ELSE '' END AS old FROM k GROUP BY parcel_id)
      SELECT parcel_id, tax_year, base AS tax_amount, tax * 25 AS appraised, CASE WHEN o % 17 = 0 THEN 0 ELSE tax * 10 END::DOUBLE AS assessed, CASE WHEN o % 17 = 0 THEN 0 ELSE base / (tax * 10) END::DOUBLE AS millage, 'P' || o AS payer_name,
        CASE WHEN coalesce(new, '') = '' OR new = old THEN nullif(old, '') WHEN starts_with(new, old) THEN new ELSE old || ' ' || new END AS district FROM k JOIN d USING (parcel_id) QUALIFY row_number() OVER (PARTITION BY parcel_id, tax_year ORDER BY pos DESC) = 1""",
    "q21_load_taxes_html": f"""WITH b AS (SELECT o_custkey AS parcel_id, (year(o_orderdate) + 20)::INT AS tax_year, o_orderkey AS o, round(o_totalprice * 100)::BIGINT AS c FROM orders WHERE year(o_orderdate) + 20 >= 2015 AND o_orderkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey DESC) = 1),
      v AS (SELECT *, CASE WHEN o % 13 = 0 THEN 0 ELSE (c * 4) / 100.0::DOUBLE END AS fair, (c // 25) / 100.0::DOUBLE AS tax FROM b)
      SELECT parcel_id, tax_year, lpad(o::VARCHAR, 12, '0') AS bill_no, '{BILL_SITE}/bill?bill_id=' || o AS bill_url, 'PAYER ' || parcel_id AS payer_name, '12/20' AS due_date, '11/02' AS paid_date, tax AS tax_amount, fair AS appraised, fair * 0.40::DOUBLE AS assessed,
        CASE WHEN fair > 0 THEN tax / (fair * 0.40::DOUBLE) * 1000 ELSE 0 END::DOUBLE AS millage, (c * 3) / 100.0::DOUBLE AS building_value, -(c / 100.0::DOUBLE) AS land_value, (c // 20) / 100.0::DOUBLE AS total_due, 0.0::DOUBLE AS back_taxes FROM v""",
    "q22_zip_reference": with_tables("counties zip_cities", "SELECT (30000 + county_id)::VARCHAR AS zip5, city, CASE WHEN city IS NOT NULL THEN 'GA' END AS state, is_preferred, minx, maxy FROM counties LEFT JOIN zip_cities ON zip5 = (30000 + county_id)::VARCHAR WHERE county_id % 3 <> 2"),
    "q23_load_counties": with_tables("counties", "SELECT county_name AS name, nullif(county_id * 100, 0)::INT AS population, CASE WHEN county_id % 4 <> 0 THEN 'R' END AS region, nullif(county_id * 2.5, 0)::DOUBLE AS acres, nullif(county_id % 3 * 1.5, 0)::DOUBLE AS square_miles, minx, miny, maxx, maxy, round((minx + maxx) / 2, 6) AS lng, round((miny + maxy) / 2, 6) AS lat, 5 AS simplified_points, round((maxx - minx) * (maxy - miny), 6) AS simplified_area FROM counties WHERE county_id % 11 <> 10"),
}
