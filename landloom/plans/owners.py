"""Owner groups and scored owner matches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.functions.geo import haversine_miles, lat_of, lng_of
from landloom.functions.normalize import confidence_band, feature_id, overlap_ratio, owner_address, owner_name, subset_ratio, surname
from landloom.operators.group_tables import GroupTables
from landloom.operators.ranking import keyset_bounds, paged
from landloom.operators.staging import shared_folder, staged
from landloom.sources.tables import counties, parcels, with_tables

#: Confidence of a group by the kind of its key; points and limits of a match.
GROUP_CONFIDENCE = {"address": 94, "pobox": 68, "name": 56, "parcel": 40}
LEAST_SCORE = 45


def owner_keys(p: DataFrame) -> DataFrame:
    """Active parcels with name, addr (normal forms), key_type and group_key."""
    p = p.where("processed IS NULL AND objectid IS NOT NULL").withColumn("name", owner_name(F.col("owner_name"))).withColumn("addr", owner_address(F.col("owner_address")))
    box = F.col("addr.is_po_box")
    kind = F.when((F.col("addr.relaxed_key") != "") & ~box, "address").when(box & (F.col("addr.po_box") != ""), "pobox").when(F.col("name") != "", "name").otherwise("parcel")
    key = (
        F.when(kind == "address", F.concat(F.lit("addr:"), F.col("addr.relaxed_key")))
        .when(kind == "pobox", F.concat(F.lit("pobox:"), F.col("addr.po_box"), F.lit("|"), F.col("addr.zip5")))
        .when(kind == "name", F.concat(F.lit("name:"), F.col("name")))
        .otherwise(F.concat(F.lit("parcel:"), feature_id(F.col("county_id"), F.col("objectid"))))
    )
    return p.withColumn("key_type", kind).withColumn("group_key", key)


def q10_owner_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner groups with their first names that are not empty, PO box flag, size and confidence."""
    first = lambda c: F.min_by(F.trim(c), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col("id")))
    groups = owner_keys(parcels(spark, sf_dir)).groupBy("group_key", "key_type").agg(first("owner_name").alias("owner_name"), F.bool_or("addr.is_po_box").alias("is_po_box"), F.count("*").alias("member_count"), F.count_distinct("county_id").alias("n_counties"))
    confidence = F.element_at(F.create_map(*[F.lit(x) for pair in GROUP_CONFIDENCE.items() for x in pair]), F.col("key_type"))
    return groups.withColumn("confidence", confidence).withColumn("band", confidence_band(F.col("confidence")))


def match_points(a: str, b: str) -> Column:
    """array<struct<points, reason>> of two parcels given as structs of name, addr, county_id, lat and lng. Points and reasons are fixed values."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    same = lambda f: (x(f) != "") & (x(f) == y(f))
    box = x("addr.is_po_box") | y("addr.is_po_box")
    place = same("addr.house") & same("addr.street_relaxed")

    def first(*cases: tuple[Column, int, str]) -> Column:
        out = F.struct(F.lit(0).alias("points"), F.lit("").alias("reason"))
        for fits, points, reason in reversed(cases):
            out = F.when(fits, F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason"))).otherwise(out)
        return out

    address = first(
        (same("addr.strict_key"), 70, "Owner address exact (strict)"), (same("addr.relaxed_key") & ~box, 62, "Owner address exact (relaxed)"), (place & same("addr.zip5"), 50, "Owner house+street+zip match"),
        (place & same("addr.city"), 35, "Owner house+street+city match"), (same("addr.zip5"), 15, "Owner ZIP match"),
    )
    other_box = x("addr.is_po_box") & y("addr.is_po_box") & (x("addr.po_box") != "") & (y("addr.po_box") != "") & (x("addr.po_box") != y("addr.po_box"))
    named = (x("name") != "") & (y("name") != "")
    overlap = overlap_ratio(x("name"), y("name"))
    name = first(
        (named & (x("name") == y("name")), 30, "Owner name exact"), (named & (subset_ratio(x("name"), y("name")) >= 0.99), 22, "Owner name subset match"), (named & (overlap >= 0.9), 22, "Owner name very similar"),
        (named & (overlap >= 0.75), 16, "Owner name similar"), (named & (overlap >= 0.6), 8, "Owner name partial overlap"),
    )
    sx, sy = surname(x("name")), surname(y("name"))
    strangers = named & (F.length(sx) > 1) & (F.length(sy) > 1) & (sx != sy) & (address["points"] < 50)
    near = haversine_miles(x("lat"), x("lng"), y("lat"), y("lng")) < 2
    return F.array(
        address, first((box, -25, "PO Box ambiguity penalty")), first((other_box, -20, "Different PO Box penalty")), name, first((strangers, -10, "Surname mismatch penalty")),
        first(((address["points"] < 35) & (x("county_id") > 0) & (x("county_id") == y("county_id")), 6, "Same county")), first((near, 4, "Nearby parcel")),
    )


#: Candidates of an anchor that are scored, and rows of a page.
CANDIDATES, PAGE = 700, 25


def _windows(text: Column, lengths: list[int]) -> Column:
    """Distinct runs of digits of these lengths anywhere in text."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    cut = lambda run, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.when(F.length(run) >= n, F.substring(run, i, F.lit(n))))
    return F.array_compact(F.array_distinct(F.flatten(F.transform(runs, lambda run: F.flatten(F.array(*[cut(run, n) for n in lengths]))))))


def candidates(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """anchor_id, id of the first CANDIDATES rows that share the anchor's owner name, begin with its surname, have its address, or hold its house number and ZIP code.

    Rows are posted under the keys that anchors ask for and meet them by equality. Each
    key keeps its first 2 * CANDIDATES rows in the final order: rows that name or surname
    puts before them can displace CANDIDATES at most.
    """
    raw = F.lower(F.trim(F.coalesce("owner_address", F.lit(""))))
    asked = anchors.select(F.col("id").alias("anchor_id"), F.lower("name").alias("name"), F.lower(surname_token(F.col("name"))).alias("surname"), raw.alias("address"), F.col("addr.house").alias("house"), F.col("addr.zip5").alias("zip5"))
    lengths = asked.agg(F.array_sort(F.collect_set(F.length("surname"))), F.array_sort(F.collect_set(F.length("house")))).first()
    surnames, houses = [[n for n in (found or []) if n] for found in lengths]
    key = lambda kind, *parts: F.concat(F.lit(kind), *[x for p in parts for x in (F.lit("|"), p)])
    blocks = F.array_compact(F.array(
        F.when(F.col("name") != "", key("n", F.col("name"))), F.when(F.col("surname") != "", key("s", F.col("surname"))),
        F.when(F.col("address") != "", key("a", F.col("address"))), F.when((F.col("house") != "") & (F.col("zip5") != ""), key("h", F.col("house"), F.col("zip5"))),
    ))
    asked = asked.select("anchor_id", "name", "surname", F.explode(blocks).alias("block"))
    low = F.lower(F.coalesce("owner_name", F.lit("")))
    held = F.coalesce("owner_address", F.lit(""))
    pairs = F.flatten(F.transform(_windows(held, houses or [1]), lambda h: F.transform(_windows(held, [5]), lambda z: key("h", h, z))))
    posts = F.concat(F.array(key("n", low), key("a", raw)), F.transform(F.filter(F.array(*map(F.lit, surnames)) if surnames else F.array().cast("array<int>"), lambda n: n <= F.length(low)), lambda n: key("s", F.left(low, n))), pairs)
    order = ["county_name", F.asc_nulls_last("site_address"), "id"]
    posted = rows.select("id", "county_name", "site_address", low.alias("low"), F.explode(F.array_distinct(posts)).alias("block")).join(asked.select("block").distinct().hint("merge"), "block", "left_semi")
    posted = posted.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy(*order))).where(F.col("nth") <= 2 * CANDIDATES)
    met = posted.join(asked.hint("merge"), "block").dropDuplicates(["anchor_id", "id"])
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.when((F.col("name") != "") & (F.col("low") == F.col("name")), 0).otherwise(1), F.when((F.col("surname") != "") & F.startswith("low", F.col("surname")), 0).otherwise(1), *order))
    return met.withColumn("first", first).where(F.col("first") <= CANDIDATES).select("anchor_id", "id")


def surname_token(name: Column) -> Column:
    """The first word of a normal form."""
    return F.coalesce(F.get(F.split(name, " "), F.lit(0)), F.lit(""))


def owner_properties(anchors: DataFrame, rows: DataFrame, page: int = PAGE) -> DataFrame:
    """The first page of properties of each anchor's owner, with all properties and counties counted. rows: of owner_keys, with county_name, lat and lng; anchors: some of them.

    An anchor whose group has several members gets these; the others are scored against
    their candidates. Members are ranked once for a group, not for each anchor.
    """
    best = [F.desc("confidence"), "county_name", F.asc_nulls_last("site_address"), "id"]
    counted = [F.count("*").alias("total"), F.count_distinct("county_name").alias("n_counties")]
    confidence = F.element_at(F.create_map(*[F.lit(x) for pair in GROUP_CONFIDENCE.items() for x in pair]), F.col("key_type"))
    groups = rows.groupBy("group_key").agg(*counted).where("total > 1")
    wanted = groups.join(anchors.select("group_key").distinct().hint("merge"), "group_key", "left_semi")
    members = rows.hint("merge").join(wanted, "group_key").withColumn("confidence", confidence).withColumn("rank", F.row_number().over(Window.partitionBy("group_key").orderBy(*best))).where(F.col("rank") <= page)
    grouped = anchors.select(F.col("id").alias("anchor_id"), "group_key").hint("merge").join(members, "group_key").select("anchor_id", "rank", "id", "confidence", F.lit("group").alias("source"), F.array().cast("array<string>").alias("reasons"), "total", "n_counties")

    alone = anchors.join(groups.hint("merge"), "group_key", "left_anti")
    side = lambda name: F.struct("name", "addr", "county_id", "lat", "lng").alias(name)
    known = rows.select("id", "county_name", "site_address", side("b")).hint("merge")  # its files are small, its rows are not: they are not sent to all tasks
    pairs = candidates(alone, rows).join(alone.select(F.col("id").alias("anchor_id"), side("a")).hint("merge"), "anchor_id").join(known, "id")
    points = pairs.withColumn("points", match_points("a", "b"))
    total_points = F.aggregate("points", F.lit(0), lambda s, p: s + p["points"])
    scored = points.withColumn("confidence", F.greatest(F.lit(0), F.least(F.lit(100), total_points))).where((F.col("confidence") >= LEAST_SCORE) | (F.col("id") == F.col("anchor_id")))
    totals = scored.groupBy("anchor_id").agg(*counted)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id").orderBy(*best))).where(F.col("rank") <= page)
    told = ranked.join(totals.hint("merge"), "anchor_id").select("anchor_id", "rank", "id", "confidence", F.lit("score").alias("source"), F.transform(F.filter("points", lambda p: p["points"] != 0), lambda p: p["reason"]).alias("reasons"), "total", "n_counties")
    return grouped.unionByName(told).withColumn("band", confidence_band(F.col("confidence")))


def q9_owner_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the owners of all parcels whose id is divisible by 100, the query set."""
    names = F.broadcast(counties(spark, sf_dir).select("county_id", "county_name"))  # a row for each county
    rows = owner_keys(parcels(spark, sf_dir)).withColumns({"lat": F.round(lat_of(F.col("my")), 9), "lng": F.round(lng_of(F.col("mx")), 9)}).join(names, "county_id")
    rows = staged(rows.select("id", "county_id", "county_name", "site_address", "owner_name", "owner_address", "name", "addr", "key_type", "group_key", "lat", "lng"))
    found = owner_properties(rows.where("id % 100 = 0"), rows)
    return found.withColumn("reasons", F.array_join("reasons", "; "))


#: Fixed value: parcels on a page of an owner's results; rows of a keyset page.
PAGE, KEYSET_PAGE = 25, 1_000


def top10_owner_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every owner group's parcels in pages of 25, by county and id: any page of any group."""
    rows = owner_keys(parcels(spark, sf_dir)).select("group_key", "county_id", "id")
    return paged(rows, ["group_key"], ["county_id", "id"], PAGE).select("group_key", "page", "pages", "nth", "id")


def top9_keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last id of each page of active parcels, by which a reader asks for one page after another."""
    return keyset_bounds(parcels(spark, sf_dir).where("processed IS NULL AND objectid IS NOT NULL"), "id", KEYSET_PAGE)


def snk7_scoped_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner groups left after county 3 was reset, with the members they still have."""
    keys = owner_keys(parcels(spark, sf_dir))
    tables = GroupTables(spark, f"{shared_folder(spark)}/landloom/groups-{uuid.uuid4().hex}")
    tables.write(keys.select("group_key", F.col("id").alias("parcel_id"), "county_id"), keys.groupBy("group_key").agg(F.min("key_type").alias("key_type")))
    tables.reset(3)
    members = tables.members().groupBy("group_key").agg(F.count("*").alias("members"))
    return tables.groups().join(members, "group_key").select("group_key", "key_type", "members")


QUERIES = {f.__name__: f for f in (q10_owner_groups, q9_owner_properties, top10_owner_pages, top9_keyset_pages, snk7_scoped_reset)}
_WORDS = "MAP {'STREET': 'ST', 'ROAD': 'RD', 'AVENUE': 'AVE', 'NORTH': 'N'}"
_TOKENS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')"
_FORMS = f""", a AS (SELECT *, upper(trim(coalesce(owner_address, ''))) AS up,
        array_to_string(list_filter({_TOKENS("regexp_replace(replace(upper(trim(coalesce(owner_name, ''))), '&', ' AND '), '[^A-Z0-9\\s]', ' ', 'g')")}, lambda t: t NOT IN ('ET', 'AL', 'TR', 'TRUST', 'LLC', 'INC', 'LTD')), ' ') AS name FROM parcels WHERE processed IS NULL AND objectid IS NOT NULL),
      b AS (SELECT *, array_to_string(list_transform({_TOKENS("string_split(up, ',')[1]")}, lambda t: coalesce({_WORDS}[t], t)), ' ') AS street0, trim(coalesce(string_split(up, ',')[2], '')) AS city, regexp_extract(up, '\\b(\\d{{5}})(?:-\\d{{4}})?\\b', 1) AS zip5, regexp_extract(up, '\\bPO BOX (\\d+)\\b', 1) AS box FROM a),
      c AS (SELECT *, regexp_extract(street0, '\\b(\\d+)\\b', 1) AS house, contains(street0, 'PO BOX') AS is_box FROM b),
      d AS (SELECT *, array_to_string(list_filter({_TOKENS("CASE WHEN house <> '' AND starts_with(street0, house) THEN trim(substr(street0, length(house) + 1)) ELSE street0 END")}, lambda t: t NOT IN ('N', 'S', 'E', 'W')), ' ') AS street FROM c)"""
_KEYS = """e AS (SELECT *, CASE WHEN up <> '' AND NOT is_box THEN 'address' WHEN is_box AND box <> '' THEN 'pobox' WHEN name <> '' THEN 'name' ELSE 'parcel' END AS key_type FROM d),
      f AS (SELECT *, CASE key_type WHEN 'address' THEN 'addr:' || house || '|' || street || '|' || city || '|' || zip5 WHEN 'pobox' THEN 'pobox:' || box || '|' || zip5 WHEN 'name' THEN 'name:' || name ELSE 'parcel:' || county_id || '_' || objectid END AS group_key FROM e)"""
ORACLES = {
    "q10_owner_groups": with_tables("parcels", f"""{_FORMS}, {_KEYS}
      SELECT group_key, key_type, arg_min(trim(owner_name), id) FILTER (trim(coalesce(owner_name, '')) <> '') AS owner_name, bool_or(is_box) AS is_po_box, count(*) AS member_count, count(DISTINCT county_id) AS n_counties,
        CASE key_type WHEN 'address' THEN 94 WHEN 'pobox' THEN 68 WHEN 'name' THEN 56 ELSE 40 END AS confidence, CASE key_type WHEN 'address' THEN 'high' WHEN 'pobox' THEN 'medium' WHEN 'name' THEN 'medium' ELSE 'low' END AS band FROM f GROUP BY group_key, key_type""").replace(" , a AS", ", a AS"),
    "q9_owner_properties": with_tables("parcels counties", f"""{_FORMS}, {_KEYS},
      r AS (SELECT f.*, county_name, round(degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2), 9) AS lat, round(degrees(mx / 6378137.0), 9) AS lng, house || '|' || street || '|' || city || '|' || zip5 AS relaxed, lower(coalesce(owner_name, '')) AS low, lower(trim(coalesce(owner_address, ''))) AS rawaddr,
        CASE WHEN up = '' THEN '' ELSE house || '|' || CASE WHEN house <> '' AND starts_with(street0, house) THEN trim(substr(street0, length(house) + 1)) ELSE street0 END || '|' || city || '|' || zip5 END AS strict, string_split(name, ' ') AS toks, list_filter(string_split(name, ' '), lambda t: t <> 'AND')[1] AS sur, string_split(lower(name), ' ')[1] AS pre FROM f JOIN counties USING (county_id)),
      g AS (SELECT group_key, count(*) AS total, count(DISTINCT county_name) AS n_counties FROM r GROUP BY 1 HAVING count(*) > 1), x AS (SELECT * FROM r WHERE id % 100 = 0),
      mem AS (SELECT x.id AS anchor_id, r.id, CASE r.key_type WHEN 'address' THEN 94 WHEN 'pobox' THEN 68 WHEN 'name' THEN 56 ELSE 40 END AS confidence, 'group' AS source, '' AS reasons, total, n_counties, r.county_name, r.site_address FROM x JOIN g USING (group_key) JOIN r USING (group_key)),
      cand AS (SELECT x AS a, r AS b FROM x ANTI JOIN g USING (group_key), r WHERE (x.name <> '' AND r.low = lower(x.name)) OR (x.pre <> '' AND starts_with(r.low, x.pre)) OR (x.rawaddr <> '' AND x.rawaddr = r.rawaddr) OR (x.house <> '' AND x.zip5 <> '' AND contains(r.up, x.house) AND contains(r.up, x.zip5))
        QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY CASE WHEN x.name <> '' AND r.low = lower(x.name) THEN 0 ELSE 1 END, CASE WHEN x.pre <> '' AND starts_with(r.low, x.pre) THEN 0 ELSE 1 END, r.county_name, r.site_address NULLS LAST, r.id) <= 700),
      ap AS (SELECT a, b, CASE WHEN a.strict <> '' AND a.strict = b.strict THEN 70 WHEN a.up <> '' AND a.relaxed = b.relaxed AND NOT a.is_box AND NOT b.is_box THEN 62
          WHEN a.house <> '' AND a.house = b.house AND a.street <> '' AND a.street = b.street AND a.zip5 <> '' AND a.zip5 = b.zip5 THEN 50 WHEN a.house <> '' AND a.house = b.house AND a.street <> '' AND a.street = b.street AND a.city <> '' AND a.city = b.city THEN 35 WHEN a.zip5 <> '' AND a.zip5 = b.zip5 THEN 15 ELSE 0 END AS p1,
        CASE WHEN a.is_box OR b.is_box THEN -25 ELSE 0 END AS p2, CASE WHEN a.is_box AND b.is_box AND a.box <> '' AND b.box <> '' AND a.box <> b.box THEN -20 ELSE 0 END AS p3,
        len(list_filter(b.toks, lambda t: list_contains(a.toks, t))) / greatest(len(a.toks), len(b.toks)) AS ov, len(list_filter(a.toks, lambda t: list_contains(b.toks, t))) / len(a.toks) AS sb, a.name <> '' AND b.name <> '' AS named FROM cand),
      np AS (SELECT *, CASE WHEN NOT named THEN 'none' WHEN a.name = b.name THEN 'exact' WHEN sb >= 0.99 THEN 'subset match' WHEN ov >= 0.9 THEN 'very similar' WHEN ov >= 0.75 THEN 'similar' WHEN ov >= 0.6 THEN 'partial overlap' ELSE 'none' END AS nm,
        CASE WHEN named AND length(a.sur) > 1 AND length(b.sur) > 1 AND a.sur <> b.sur AND p1 < 50 THEN -10 ELSE 0 END AS p5, CASE WHEN p1 < 35 AND a.county_id > 0 AND a.county_id = b.county_id THEN 6 ELSE 0 END AS p6,
        CASE WHEN 2 * 3958.8 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)), sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) < 2 THEN 4 ELSE 0 END AS p7 FROM ap),
      sc AS (SELECT a.id AS anchor_id, b.id AS id, greatest(0, least(100, p1 + p2 + p3 + CASE nm WHEN 'exact' THEN 30 WHEN 'subset match' THEN 22 WHEN 'very similar' THEN 22 WHEN 'similar' THEN 16 WHEN 'partial overlap' THEN 8 ELSE 0 END + p5 + p6 + p7)) AS confidence, 'score' AS source,
        array_to_string(list_filter([CASE p1 WHEN 70 THEN 'Owner address exact (strict)' WHEN 62 THEN 'Owner address exact (relaxed)' WHEN 50 THEN 'Owner house+street+zip match' WHEN 35 THEN 'Owner house+street+city match' WHEN 15 THEN 'Owner ZIP match' END, CASE WHEN p2 < 0 THEN 'PO Box ambiguity penalty' END, CASE WHEN p3 < 0 THEN 'Different PO Box penalty' END,
          CASE WHEN nm <> 'none' THEN 'Owner name ' || nm END, CASE WHEN p5 < 0 THEN 'Surname mismatch penalty' END, CASE WHEN p6 > 0 THEN 'Same county' END, CASE WHEN p7 > 0 THEN 'Nearby parcel' END], lambda t: t IS NOT NULL), '; ') AS reasons, b.county_name AS county_name, b.site_address AS site_address FROM np),
      kept AS (SELECT *, count(*) OVER (PARTITION BY anchor_id) AS total FROM sc WHERE confidence >= 45 OR id = anchor_id), nc AS (SELECT anchor_id, count(DISTINCT county_name) AS n_counties FROM kept GROUP BY 1),
      both_ AS (SELECT anchor_id, id, confidence, source, reasons, total, n_counties, county_name, site_address FROM mem UNION ALL SELECT anchor_id, id, confidence, source, reasons, total, n_counties, county_name, site_address FROM kept JOIN nc USING (anchor_id))
      SELECT anchor_id, row_number() OVER (PARTITION BY anchor_id ORDER BY confidence DESC, county_name, site_address NULLS LAST, id) AS rank, id, confidence, source, reasons, total, n_counties, CASE WHEN confidence >= 85 THEN 'high' WHEN confidence >= 55 THEN 'medium' ELSE 'low' END AS band FROM both_ QUALIFY rank <= 25""").replace(" , a AS", ", a AS"),
}
ORACLES |= {
    "top10_owner_pages": with_tables("parcels", f"""{_FORMS}, {_KEYS}, n AS (SELECT group_key, id, row_number() OVER (PARTITION BY group_key ORDER BY county_id, id) AS nth, count(*) OVER (PARTITION BY group_key) AS held FROM f)
      SELECT group_key, (nth + {PAGE - 1}) // {PAGE} AS page, (held + {PAGE - 1}) // {PAGE} AS pages, nth, id FROM n""").replace(" , a AS", ", a AS"),
    "top9_keyset_pages": with_tables("parcels", f"SELECT (nth + {KEYSET_PAGE - 1}) // {KEYSET_PAGE} AS page, min(id) AS first_key, max(id) AS last_key, count(*) AS n FROM (SELECT id, row_number() OVER (ORDER BY id) AS nth FROM parcels WHERE processed IS NULL AND objectid IS NOT NULL) GROUP BY 1"),
    "snk7_scoped_reset": with_tables("parcels", f"""{_FORMS}, {_KEYS} SELECT group_key, min(key_type) AS key_type, count(*) AS members FROM f WHERE county_id <> 3 GROUP BY group_key""").replace(" , a AS", ", a AS"),
}
