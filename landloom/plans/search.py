"""Address and owner search for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.functions.normalize import collapsed, tokens, trigrams
from landloom.operators.fuzzy import similar_texts, similarity, starting_with
from landloom.operators.staging import staged
from landloom.plans.places import ORACLES as PLACES
from landloom.plans.places import q11_parcel_search
from landloom.sources.tables import counties, parcels, with_tables

#: Results at most, shortest query, shortest one that is also searched by similarity, and similar rows ranked for each result that is lacking.
LIMIT, SHORTEST, FUZZY_FROM, FUZZY_TIMES = 10, 2, 5, 4
_ZIP = r"\b(\d{5})(?:-\d{4})?\b"


def query_parts(raw: DataFrame) -> DataFrame:
    """query_id, q (normal form), zip, city and street tokens of raw queries (query_id, q); those that are too short are dropped.

    The token `ga` is no part of a city; letters inside a word are kept.
    """
    rows = raw.select("query_id", F.lower(collapsed(F.coalesce("q", F.lit("")))).alias("q")).where(F.length("q") >= SHORTEST)
    street = collapsed(F.get(F.split(F.trim(F.regexp_replace("q", _ZIP, " ")), ","), F.lit(0)))
    city = F.array_join(F.filter(tokens(F.regexp_replace(F.coalesce(F.get(F.split("q", ","), F.lit(1)), F.lit("")), r"[^a-z\s]", " ")), lambda t: t != "ga"), " ")
    return rows.select("query_id", "q", F.regexp_extract("q", _ZIP, 1).alias("zip"), city.alias("city"), F.when(street == "", F.col("q")).otherwise(street).alias("street"))


def _alike(rows: DataFrame, most: int) -> DataFrame:
    """Rows that are alike but for their id as one: id, the least, and ids, the first so many in order."""
    columns = [c for c in rows.columns if c != "id"]
    kept = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*columns).orderBy("id"))).where(F.col("_nth") <= most)
    return kept.groupBy(*columns).agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))


def _ranked(asking: DataFrame, rows: DataFrame, asked: str, text: str, prefix_order: list[Column], fuzzy_score: Column, first_order: list[Column], fuzzy_order: list[Column], limit: int, query_grams: dict[str, Column], row_grams: dict[str, Column]) -> DataFrame:
    """query_id, rank, id, stage (0 prefix, 1 similar): prefix rows first, then similar ones that are not among them until there are limit.

    Every order ends with the id. So of rows that are alike but for it only the first FUZZY_TIMES * limit can be told, and rows that one of the first n
    groups of alike rows holds (by their least ids) are before those of all later groups: groups are scored and ranked, and the first n alone give their rows. Queries that are alike are asked once.
    """
    asking = asking.withColumn("_asked", F.to_json(F.struct(*[c for c in asking.columns if c != "query_id"])))
    members = staged(asking.select("query_id", "_asked"))
    queries = staged(asking.drop("query_id").dropDuplicates(["_asked"]).withColumnRenamed("_asked", "query_id").withColumns(query_grams))
    groups = staged(_alike(rows, FUZZY_TIMES * limit).withColumnRenamed(text, "text").withColumns(row_grams))
    told = queries.select("query_id", F.col(asked).alias("q"))
    texts = groups.select("text")
    full = lambda met: met.join(groups, "text").join(queries, "query_id")
    by = lambda order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))

    def best_rows(found: DataFrame, order: list[Column], most: Column) -> DataFrame:
        """The first rows of a query's groups, as nth."""
        few = found.withColumn("nth", by(order)).where(F.col("nth") <= most)
        each = few.select(*[c for c in few.columns if c not in ("id", "ids", "nth")], F.explode("ids").alias("id"))
        return each.withColumn("nth", by(order)).where(F.col("nth") <= most)

    first = staged(best_rows(full(starting_with(told, texts)), prefix_order, F.lit(limit)).select("query_id", "id", "nth"))
    counts = first.groupBy("query_id").agg(F.count("*").alias("held"))
    lacking = staged(queries.where(F.length("q") >= FUZZY_FROM).join(counts, "query_id", "left").withColumn("needed", limit - F.coalesce("held", F.lit(0))).where("needed > 0").drop("held"))
    similar = similar_texts(lacking.select("query_id", F.col(asked).alias("q")), texts).select("query_id", "text")
    scored = full(similar).join(lacking.select("query_id", "needed"), "query_id").withColumn("score", F.round(fuzzy_score, 9))
    scored = best_rows(scored, first_order, FUZZY_TIMES * F.col("needed")).withColumn("nth", by(fuzzy_order))
    both = first.select("query_id", "id", F.lit(0).alias("stage"), "nth").unionByName(scored.select("query_id", "id", F.lit(1).alias("stage"), "nth"))
    best = both.groupBy("query_id", "id").agg(F.min(F.struct("stage", "nth")).alias("at")).withColumn("rank", by(["at"])).where(F.col("rank") <= limit)
    return best.select(F.col("query_id").alias("_asked"), "rank", "id", F.col("at.stage").alias("stage")).join(members, "_asked").select("query_id", "rank", "id", "stage")


def _place_ranks(city: str) -> list[Column]:
    known = F.col("city_token") != ""
    return [
        F.when((F.col("zip") != "") & (F.col("zip5") == F.col("zip")), 0).otherwise(1),
        F.when(known & (F.lower(city) == F.col("city_token")), 0).when(known & F.startswith(F.lower(city), F.col("city_token")), 1).otherwise(2),
    ]


def search_address(raw: DataFrame, rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows: id, site_norm, display, place_city, zip5."""
    queries = query_parts(raw).withColumnRenamed("city", "city_token")
    exact = F.when(F.col("text") == F.col("street"), 0).otherwise(1)
    shown = F.coalesce("display", F.lit(""))
    score = F.greatest(similarity(F.col("text_grams"), F.col("street_grams")), similarity(F.col("shown_grams"), F.col("q_grams")))
    grams = {"q_grams": trigrams(F.col("q")), "street_grams": trigrams(F.col("street"))}, {"text_grams": trigrams(F.col("text")), "shown_grams": trigrams(shown)}
    places = _place_ranks("place_city")
    return _ranked(queries, rows.where("site_norm <> ''"), "street", "site_norm", [exact, *places, F.length(shown), shown, F.col("id")], score, [F.desc("score"), F.col("id")], [F.desc("score"), *places, F.col("id")], limit, *grams)


def search_owner(raw: DataFrame, rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows: id, owner_name."""
    queries = query_parts(raw).select("query_id", "q")
    named = rows.where("owner_name <> ''").withColumn("low", F.lower("owner_name"))
    exact = F.when(F.col("text") == F.col("q"), 0).when(F.startswith("text", F.concat("q", F.lit(" "))), 1).otherwise(2)
    score = similarity(F.col("text_grams"), F.col("q_grams"))
    order = [F.desc("score"), F.col("owner_name"), F.col("id")]
    return _ranked(queries, named, "q", "low", [exact, F.length("owner_name"), F.col("owner_name"), F.col("id")], score, order, order, limit, {"q_grams": trigrams(F.col("q"))}, {"text_grams": trigrams(F.col("text"))})


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q11_parcel_search(spark, sf_dir).select("id", "site_norm", "display", F.col("city").alias("place_city"), "zip5")


def _asked(rows: DataFrame, text: Column, tail: Callable[[Column], Column]) -> DataFrame:
    """The query set: of each parcel whose id is divisible by 100 its text, cut, misspelt or with a place behind it."""
    i = (F.col("id") / 100).cast("long") % 4
    q = F.when(i == 0, F.left(text, F.lit(7))).when(i == 1, F.concat(F.left(text, F.lit(4)), F.substring(text, F.lit(6), F.lit(99)))).when(i == 2, F.concat(F.upper(text), F.lit(" "))).otherwise(tail(text))
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), q.alias("q"))


def q7_search_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(search_rows(spark, sf_dir))
    return search_address(_asked(rows, F.col("site_norm"), lambda t: F.concat(t, F.lit(", "), F.coalesce("place_city", F.lit("x")), F.lit(" GA "), F.coalesce("zip5", F.lit("")))), rows)


def q8_search_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the active parcels of the state, as the reference restricts owners to it."""
    home = counties(spark, sf_dir).where("state = 'GA'").select("county_id")
    rows = staged(parcels(spark, sf_dir).where("processed IS NULL AND objectid IS NOT NULL").join(home, "county_id").select("id", "owner_name"))
    return search_owner(_asked(parcels(spark, sf_dir), F.coalesce("owner_name", F.lit("")), lambda t: F.concat(F.substring(t, F.lit(1), F.lit(1)), F.lit("x"), F.substring(t, F.lit(3), F.lit(99)))), rows)


QUERIES = {f.__name__: f for f in (q7_search_address, q8_search_owner)}
_GRAMS = lambda c: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = lambda a, b: f"(len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b}))))"
_CUT = lambda t, tail: f"CASE (id // 100) % 4 WHEN 0 THEN substr({t}, 1, 7) WHEN 1 THEN substr({t}, 1, 4) || substr({t}, 6) WHEN 2 THEN upper({t}) || ' ' ELSE {tail} END"
_WITH = PLACES["q11_parcel_search"].rpartition("SELECT id, lower(site)")


def _stages(prefix: str, prefix_order: str, sim: str, score: str, first_order: str, fuzzy_order: str) -> str:
    return f"""pre AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {prefix_order}) AS nth FROM a WHERE {prefix} QUALIFY nth <= 10),
      lack AS (SELECT query_id, 10 - count(id) AS needed FROM (SELECT DISTINCT query_id, q FROM a WHERE length(q) >= 5) LEFT JOIN pre USING (query_id) GROUP BY query_id HAVING count(id) < 10),
      fuz AS (SELECT *, round({score}, 9) AS score FROM a JOIN lack USING (query_id) WHERE {sim} >= 0.3),
      pick AS (SELECT * FROM fuz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {first_order}) <= 4 * needed),
      allr AS (SELECT query_id, id, 0 AS stage, nth FROM pre UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY {fuzzy_order}) FROM pick),
      found AS (SELECT query_id, id, min(stage * 1000000 + nth) AS place FROM allr GROUP BY ALL)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, id, (place >= 1000000)::INT AS stage FROM found QUALIFY rank <= 10"""


ORACLES = {
    "q7_search_address": f"""{_WITH[0].rstrip()}, s AS ({_WITH[1]}{_WITH[2]}),
      raw AS (SELECT id AS query_id, trim(regexp_replace(lower({_CUT("site_norm", "site_norm || ', ' || coalesce(city, 'x') || ' GA ' || coalesce(zip5, '')")}), '\\s+', ' ', 'g')) AS q FROM s WHERE id % 100 = 0 AND site_norm IS NOT NULL),
      q1 AS (SELECT *, regexp_extract(q, '\\b(\\d{{5}})\\b', 1) AS zip, trim(regexp_replace(regexp_replace(coalesce(string_split(q, ',')[2], ''), '[^a-z ]', ' ', 'g'), '\\bga\\b| +', ' ', 'g')) AS city_token, trim(string_split(regexp_replace(q, '\\b\\d{{5}}\\b', ' ', 'g'), ',')[1]) AS street0 FROM raw WHERE length(q) >= 2),
      q2 AS (SELECT query_id, q, zip, trim(regexp_replace(city_token, ' +', ' ', 'g')) AS city_token, CASE WHEN street0 = '' THEN q ELSE street0 END AS street FROM q1),
      g2 AS (SELECT *, {_GRAMS("street")} AS gs, {_GRAMS("q")} AS gq FROM q2), st AS (SELECT id, site_norm, coalesce(display, '') AS display, city AS place_city, zip5, {_GRAMS("site_norm")} AS g, {_GRAMS("coalesce(display, '')")} AS gd FROM s WHERE site_norm <> ''),
      a AS (SELECT *, CASE WHEN zip <> '' AND zip5 = zip THEN 0 ELSE 1 END AS zr, CASE WHEN city_token <> '' AND lower(place_city) = city_token THEN 0 WHEN city_token <> '' AND starts_with(lower(place_city), city_token) THEN 1 ELSE 2 END AS cr FROM g2, st),
      {_stages("starts_with(site_norm, street)", "CASE WHEN site_norm = street THEN 0 ELSE 1 END, zr, cr, length(display), display, id", _SIM("g", "gs"), f"greatest({_SIM('g', 'gs')}, {_SIM('gd', 'gq')})", "score DESC, id", "score DESC, zr, cr, id")}""",
    "q8_search_owner": with_tables("parcels counties", f""", raw AS (SELECT id AS query_id, trim(regexp_replace(lower({_CUT("coalesce(owner_name, '')", "substr(coalesce(owner_name, ''), 1, 1) || 'x' || substr(coalesce(owner_name, ''), 3)")}), '\\s+', ' ', 'g')) AS q FROM parcels WHERE id % 100 = 0),
      g2 AS (SELECT *, {_GRAMS("q")} AS gq FROM raw WHERE length(q) >= 2), st AS (SELECT id, owner_name, lower(owner_name) AS low, {_GRAMS("owner_name")} AS g FROM parcels JOIN counties USING (county_id) WHERE state = 'GA' AND processed IS NULL AND objectid IS NOT NULL AND owner_name <> ''),
      a AS (SELECT * FROM g2, st),
      {_stages("starts_with(low, q)", "CASE WHEN low = q THEN 0 WHEN starts_with(low, q || ' ') THEN 1 ELSE 2 END, length(owner_name), owner_name, id", _SIM("g", "gq"), _SIM("g", "gq"), "score DESC, owner_name, id", "score DESC, owner_name, id")}""").replace(" , raw", ", raw"),
}
