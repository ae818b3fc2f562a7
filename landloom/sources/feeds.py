"""Feeds as sources: documents of features, tax records and pages, parsed by columns. Documents come in a column `doc`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.geo import let, parsed_geometry, parsed_wkt
from landloom.functions.normalize import collapsed, preferred_flag, title_words, zip5

_GEOJSON = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
_ESRI = "features array<struct<attributes:map<string,string>,geometry:struct<rings:array<array<array<double>>>,x:double,y:double>>>"
_WKT = "d array<struct<Key:string,WktGeometry:string,Address:string,TipHtml:string,ResultHtml:string>>"
_TAXES = "TotalRecords int, Records array<struct<District:string,Year:int,Values:struct<Appraised:double,Assessed:double,BaseTax:double>,Payment:struct<Status:string,PayerName:string>>>"
_COUNTIES = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<NAME10:string,totpop10:int,Reg_Comm:string,Acres:double,Sq_Miles:double>>>"
_PLACES = "`post code` string, places array<struct<`place name`:string,`state abbreviation`:string>>"

#: Names under which a feed may hold a ZIP code, in order, and aliases of the columns of a ZIP and city file.
ZIP_NAMES = ["zip5", "ZIP5", "zip", "ZIP", "zipcode", "ZIPCODE", "ZCTA5CE10", "ZCTA5CE20", "GEOID10", "GEOID20", "postalcode", "POSTALCODE"]
CITY_COLUMNS = {"zip": "zip5", "zipcode": "zip5", "zip5": "zip5", "zcta5": "zip5", "city": "city", "cityname": "city", "preferredcity": "city", "uspscity": "city", "state": "state", "stateabbr": "state", "ispreferred": "preferred", "preferred": "preferred", "primary": "preferred", "defaultcity": "preferred"}


def features(docs: DataFrame) -> DataFrame:
    """The other columns of docs with props (map) and geom of each feature, GeoJSON or Esri JSON; a document that is neither gives no row.

    An Esri geometry without rings is a point if it has coordinates, else null.
    """
    rest = [c for c in docs.columns if c != "doc"]
    point = lambda g: F.array(F.array(F.array(F.struct(g["x"].alias("x"), g["y"].alias("y")))))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    of_esri = lambda g: F.when(F.size(g["rings"]) > 0, F.array(F.transform(g["rings"], ring))).when((g["x"] != 0) | (g["y"] != 0), point(g))
    plain = F.transform("geo.features", lambda f: F.struct(f["properties"].alias("props"), parsed_geometry(f["geometry"]["type"], f["geometry"]["coordinates"]).alias("geom")))
    esri = F.transform("esri.features", lambda f: F.struct(f["attributes"].alias("props"), of_esri(f["geometry"]).alias("geom")))
    only = lambda mark, schema: F.from_json(F.when(F.contains("doc", F.lit(mark)), F.col("doc")), schema)  # noqa: E731  a document of the other kind isn't parsed for this one
    read = docs.withColumn("geo", only('"properties"', _GEOJSON)).withColumn("esri", only('"attributes"', _ESRI))
    is_esri = F.exists(F.coalesce("esri.features", F.array()), lambda f: f["attributes"].isNotNull())
    return read.select(*rest, F.explode(F.when(is_esri, esri).otherwise(plain)).alias("f")).select(*rest, "f.props", "f.geom")


def county_features(docs: DataFrame) -> DataFrame:
    """name, population, region, acres, square_miles (null where not positive or empty) and geom, of documents with one feature, which has a name."""
    one = docs.select(F.from_json("doc", _COUNTIES)["features"].alias("fs")).where(F.size("fs") == 1).select(F.col("fs")[0].alias("f"))
    p = lambda c: F.col(f"f.properties.{c}")
    positive = lambda c: F.when(c > 0, c)
    geom = parsed_geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return one.select(p("NAME10").alias("name"), positive(p("totpop10")).alias("population"), F.nullif(p("Reg_Comm"), F.lit("")).alias("region"), positive(p("Acres")).alias("acres"), positive(p("Sq_Miles")).alias("square_miles"), geom.alias("geom")).where("name IS NOT NULL")


def wkt_features(docs: DataFrame) -> DataFrame:
    """The other columns of docs with key, address, html, wkt and geom of each feature; those without key or geometry are skipped, repeats of both dropped."""
    rest = [c for c in docs.columns if c != "doc"]
    rows = docs.select(*rest, F.explode(F.from_json("doc", _WKT)["d"]).alias("d"))
    rows = rows.select(*rest, F.col("d.Key").alias("key"), F.col("d.Address").alias("address"), F.col("d.ResultHtml").alias("html"), F.col("d.WktGeometry").alias("wkt"))
    return rows.where("key <> '' AND wkt <> ''").dropDuplicates(["key", "wkt"]).withColumn("geom", parsed_wkt(F.col("wkt")))


def tax_records(docs: DataFrame) -> DataFrame:
    """The other columns of docs with pos, district, tax_year, appraised, assessed, base_tax and payer_name of each record, in feed order."""
    rest = [c for c in docs.columns if c != "doc"]
    rows = docs.select(*rest, F.posexplode(F.from_json("doc", _TAXES)["Records"]).alias("pos", "r"))
    return rows.select(*rest, "pos", F.col("r.District").alias("district"), F.col("r.Year").alias("tax_year"), F.col("r.Values.Appraised").alias("appraised"), F.col("r.Values.Assessed").alias("assessed"), F.col("r.Values.BaseTax").alias("base_tax"), F.col("r.Payment.PayerName").alias("payer_name"))


def plain_text(html: Column) -> Column:
    """Text of a piece of a page: without tags, blanks trimmed."""
    return F.trim(F.replace(F.regexp_replace(html, "<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" ")))


def bill_links(pages: DataFrame, base: str) -> DataFrame:
    """The other columns of pages with bill_no, tax_year and url of the bills listed: real property, from 2015 on."""
    rest = [c for c in pages.columns if c != "doc"]
    body = F.regexp_extract("doc", r'(?is)id="tbl_tax_results".*?</table>', 0)
    cell = lambda row, name: plain_text(F.regexp_extract(row, rf'(?is)<td[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</td>', 1))
    rows = pages.select(*rest, F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    href = F.regexp_extract("row", r'(?is)<td[^>]*\btax_bill_no\b[^>]*>.*?<a[^>]*href="([^"]*)"', 1)
    told = rows.select(*rest, cell(F.col("row"), "tax_year").try_cast("int").alias("tax_year"), cell(F.col("row"), "tax_map_type").alias("kind"), cell(F.col("row"), "tax_bill_no").alias("bill_no"), href.alias("href"))
    url = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    return told.where("tax_year >= 2015 AND kind = 'Real' AND href <> ''").select(*rest, "bill_no", "tax_year", url.alias("url"))


def bill_fields(html: Column) -> Column:
    """The fields of a bill page as text, '' where absent: from cells with a label and from the summary's rows. Each table is cut from the page once."""
    table = lambda name: F.regexp_extract(html, rf'(?is)<table[^>]*(?:id|class)="[^"]*\b{name}\b.*?</table>', 0)
    labelled = lambda of, label, css="": plain_text(F.regexp_extract(of, rf'(?is)<td(?=[^>]*data-label="{label}")(?=[^>]*{css})[^>]*>(.*?)</td>', 1))
    row = lambda of, label: plain_text(F.regexp_extract(of, rf"(?is)<tr[^>]*>\s*<td[^>]*>(?:\s|<strong>)*{label}(?:\s|</strong>)*</td>\s*<td[^>]*>(.*?)</td>", 1))

    def told(tables: Column) -> Column:
        owner, item, summary = tables["owner"], tables["item"], tables["summary"]
        return F.struct(
            labelled(owner, "Tax Payer:").alias("payer_name"), labelled(owner, "Location:").alias("location"), labelled(owner, "District:").alias("district"),
            labelled(item, "Building Value:", "tax_item_building_value").alias("building_value"), labelled(item, "Land Value:", "tax_item_land_value").alias("land_value"),
            labelled(item, "Fair Market Value:", "tax_item_f_m_value").alias("fair_market_value"), labelled(item, "Due Date:", "tax_item_due_date").alias("due_date"),
            row(summary, "Current Due").alias("tax_amount"), row(summary, "Back Taxes").alias("back_taxes"), row(summary, "Total Due").alias("total_due"), row(summary, "Paid Date").alias("paid_date"),
        )

    return let(F.struct(table("tbl_temp").alias("owner"), table("tbl_tax_bill_item").alias("item"), table("tbl_tax_detail_sumary").alias("summary")), told)


def detail_fields(html: Column) -> Column:
    """class_code, tax_district, physical_address and owner_block of a detail page, '' where absent."""
    value = lambda label: F.trim(F.regexp_extract(html, rf"(?i)<strong>\s*(?:{label})(?:&nbsp;|\s)*</strong>\s*</td>\s*<td[^>]*>\s*(.*?)\s*</td>", 1))
    return F.struct(
        value(r"Class\s*Code|Class").alias("class_code"), value(r"Tax(?:ing)?\s*District|District").alias("tax_district"),
        value(r"Physical\s*Address|Property\s*Address").alias("physical_address"), value(r"Owner(?:\s*Address(?:&nbsp;|\s)*)?").alias("owner_block"),
    )


def zip_areas(docs: DataFrame) -> DataFrame:
    """zip5 (of the first name that a feature holds) and geom; features without a valid code are dropped."""
    found = features(docs)
    named = F.get(F.filter(F.array(*map(F.lit, ZIP_NAMES)), lambda n: F.map_contains_key("props", n)), F.lit(0))
    return found.select(zip5(F.element_at("props", named)).alias("zip5"), "geom").where("zip5 <> ''")


def zip_cities_of(rows: DataFrame) -> DataFrame:
    """zip5, city, state, is_preferred of a file's rows, whatever its columns' names are among CITY_COLUMNS (the last that fits wins); rows without code or city are dropped."""
    found = {}
    for name in rows.columns:
        if (plain := "".join(c for c in name.lower() if c.isalnum())) in CITY_COLUMNS:
            found[CITY_COLUMNS[plain]] = F.col(f"`{name}`")
    if "zip5" not in found or "city" not in found:
        raise ValueError("no column for the ZIP code or the city")
    state = F.upper(F.trim(found.get("state", F.lit("GA"))))
    flag = preferred_flag(found["preferred"]) if "preferred" in found else F.lit(False)
    return rows.select(zip5(found["zip5"]).alias("zip5"), title_words(found["city"]).alias("city"), F.coalesce(F.nullif(state, F.lit("")), F.lit("GA")).alias("state"), flag.alias("is_preferred")).where("zip5 <> '' AND city <> ''")


def zip_city_documents(docs: DataFrame) -> DataFrame:
    """zip5 and city of each document's first place, kept if it lies in the state and has a name."""
    d = docs.select(F.from_json("doc", _PLACES).alias("d"))
    place = F.get("d.places", F.lit(0))
    rows = d.select(zip5(F.col("d.`post code`")).alias("zip5"), collapsed(place["place name"]).alias("city"), F.upper(F.trim(place["state abbreviation"])).alias("state"))
    return rows.where("state = 'GA' AND city <> '' AND zip5 <> ''")
