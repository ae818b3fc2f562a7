"""Logical tables (parcels, taxes, counties, ...) derived from the driver's tables by whole-number arithmetic.

Each has a DuckDB counterpart in ``CTES`` so that oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["ANN", "BOB", "CARL", "DEE", "EVE", "FAY", "GUS"]
LAST = ["SMITH", "JONES", "OAKLEY", "PARK", "REED", "STONE", "TATE", "UNDERWOOD", "VALE", "WEST", "YOUNG"]
SUFFIX = ["", " & CO", " TRUST", " LLC", "", " ET AL", ""]
STREET = ["OAK", "MAIN", "NORTH PINE", "N PINE", "LAKE"]
KIND = ["STREET", "ST", "ROAD", "AVENUE"]
CITY = ["ATLANTA", "MACON", "SAVANNAH", "ATHENS"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def _sql_pick(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({index}) + 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to as many tasks as shuffles and cores ask for. A narrow table may be one row group of one file, which is one task, however much is computed from each row."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    seventh = F.floor(k / 7).cast("long")
    house = (100 + k % 60).cast("string")
    address = F.concat(house, F.lit(" "), _pick(STREET, k % 5), F.lit(" "), _pick(KIND, seventh % 4), F.lit(", "), _pick(CITY, k % 4), F.lit(", GA "), (30000 + k % 25).cast("string"))
    site = F.concat(house, F.lit(" "), _pick(STREET, k % 5), F.lit(" "), _pick(KIND, seventh % 4))
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.alias("id"), F.when(k % 97 != 0, k).alias("objectid"), F.col("c_nationkey").alias("county_id"), F.col("c_name").alias("parcel_id"), F.col("c_mktsegment").alias("classification"),
        (F.lit(-9520000) + (k % 211) * 1700).cast("double").alias("mx"), (F.lit(3560000) + (k % 199) * 2100).cast("double").alias("my"), (20 + 10 * (k % 5)).cast("double").alias("side"),
        F.when(k % 41 == 0, F.lit(None)).when(k % 43 == 0, "").otherwise(F.concat(_pick(FIRST, k % 7), F.lit(" "), _pick(LAST, seventh % 11), _pick(SUFFIX, k % 7))).alias("owner_name"),
        F.when(k % 37 == 0, F.lit(None)).when(k % 31 == 0, F.concat(F.lit("PO BOX "), (k % 9).cast("string"), F.lit(", MACON, GA 31201"))).otherwise(address).alias("owner_address"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.initcap(site), F.lit("  "))).alias("site_address"),
        F.when(k % 50 == 7, False).alias("processed"),
    )


def parcel_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each tax record as fed; several of a (parcel, year) differ in seq."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("parcel_id"), F.year("o_orderdate").alias("tax_year"), (F.col("o_totalprice") / 100).alias("tax_amount"), F.col("o_orderkey").alias("seq")
    )


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    i = F.col("n_nationkey")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        i.alias("county_id"), F.col("n_name").alias("county_name"), F.when(F.col("r_name") == "AMERICA", "GA").otherwise("XX").alias("state"),
        (-86 + 0.75 * (i % 5)).alias("minx"), (30.4 + 0.7 * F.floor(i / 5)).alias("miny"), (-86 + 0.75 * (i % 5) + 0.75).alias("maxx"), (30.4 + 0.7 * F.floor(i / 5) + 0.7).alias("maxy"),
    )


#: Lots of a row, and points that a border between two of them has besides its ends.
LOT_ROW, LOT_STEPS = 25, 9


def _lot_border(i: Column, j: Column, upright: bool) -> Column:
    """How far each point of a border stands out of its straight line: a spike of 30 in every fourth, else by 1 at most."""
    a, b = (i * 5 + j * 3, i * 2 + j * 7) if upright else (i * 3 + j * 5, i * 7 + j * 3)
    side = F.when((i + j) % 2 == 0, 6).otherwise(-6)
    return F.transform(F.sequence(F.lit(1), F.lit(LOT_STEPS)), lambda t: F.when(a % 4 == 0, side * F.least(t, 10 - t)).otherwise((b + t * 5) % 3 - 1).cast("double"))


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, county_id, geom: lots of 100 by 100 side by side, whose jagged borders neighbours share point by point."""
    n = F.col("c_custkey")
    i, j = n % LOT_ROW, F.floor(n / LOT_ROW)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    level = lambda i, j: F.transform(_lot_border(i, j, False), lambda d, t: point(i * 100 + (t + 1) * 10, j * 100 + d))
    upright = lambda i, j: F.transform(_lot_border(i, j, True), lambda d, t: point(i * 100 + d, j * 100 + (t + 1) * 10))
    corner = lambda i, j: F.array(point(i * 100, j * 100))
    ring = F.concat(corner(i, j), level(i, j), corner(i + 1, j), upright(i + 1, j), corner(i + 1, j + 1), F.reverse(level(i, j + 1)), corner(i, j + 1), F.reverse(upright(i, j)), corner(i, j))
    shape = F.explode(F.array(F.array(F.array(ring))))  # from a generator, so that no filter on shapes is pushed below the dealing, where one task would lay all of them out
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("county_id"), shape.alias("geom"))


def class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    category = F.when(code.isin("HOUSEHOLD", "FURNITURE"), "Residential").when(code == "AUTOMOBILE", "Commercial").otherwise("Other")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("county_id"), F.col("c_mktsegment").alias("code")).distinct().where("county_id % 7 <> 3").withColumn("category", category).withColumn("is_residential", F.col("category") == "Residential")


def zip_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP areas, a little larger than a county each, so that neighbours overlap; some counties have none."""
    c = counties(spark, sf_dir).where("county_id % 6 <> 5")
    grown = [(F.col(b) + (-0.04 if b.startswith("min") else 0.04)).alias(b) for b in ("minx", "miny", "maxx", "maxy")]
    return c.select((30000 + F.col("county_id")).cast("string").alias("zip5"), *grown)


def zip_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zip5, geom: ZIP areas without their upper right corner and with a hole; a second part lies in the missing corner."""
    at = lambda low, high, share: F.col(low) + share * (F.col(high) - F.col(low))
    x, y = (lambda share: at("minx", "maxx", share)), (lambda share: at("miny", "maxy", share))
    ring = lambda *corners: F.array(*[F.struct(x(a).alias("x"), y(b).alias("y")) for a, b in (*corners, corners[0])])
    box = lambda low, high: ring((low, low), (high, low), (high, high), (low, high))
    notched = ring((0, 0), (1, 0), (1, 0.6), (0.6, 0.6), (0.6, 1), (0, 1))
    return zip_areas(spark, sf_dir).select("zip5", F.array(F.array(notched, box(0.1, 0.3)), F.array(box(0.7, 0.9))).alias("geom"))


def zip_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    i = F.col("n_nationkey")
    zip5 = (30000 + i).cast("string")
    n = n.where("n_nationkey % 8 <> 6")
    return n.select(zip5.alias("zip5"), F.concat(F.lit("Town "), i.cast("string")).alias("city"), (i % 3 == 0).alias("is_preferred")).unionByName(
        n.select(zip5.alias("zip5"), F.concat(F.lit("Burg "), i.cast("string")).alias("city"), (i % 3 == 1).alias("is_preferred"))
    )


def _sql_border(i: str, j: str, upright: bool) -> str:
    a, b = (f"{i} * 5 + {j} * 3", f"{i} * 2 + {j} * 7") if upright else (f"{i} * 3 + {j} * 5", f"{i} * 7 + {j} * 3")
    return f"list_transform(range(1, {LOT_STEPS + 1}), lambda t: CASE WHEN ({a}) % 4 = 0 THEN (CASE WHEN ({i} + {j}) % 2 = 0 THEN 6 ELSE -6 END) * least(t, 10 - t) ELSE ({b} + t * 5) % 3 - 1 END)"


def in_zip_sql(x: str, y: str) -> str:
    """Whether the ZIP area of a row of zip_areas covers a point."""
    at = lambda low, high, share: f"({low} + {share}::DOUBLE * ({high} - {low}))"
    mx, my = (lambda share: at("minx", "maxx", share)), (lambda share: at("miny", "maxy", share))
    hole = f"({x} > {mx(0.1)} AND {x} < {mx(0.3)} AND {y} > {my(0.1)} AND {y} < {my(0.3)})"
    notched = f"{x} BETWEEN minx AND {mx(1)} AND {y} BETWEEN miny AND {my(1)} AND ({y} <= {my(0.6)} OR {x} <= {mx(0.6)}) AND NOT {hole}"
    return f"(({notched}) OR ({x} BETWEEN {mx(0.7)} AND {mx(0.9)} AND {y} BETWEEN {my(0.7)} AND {my(0.9)}))"


_K = "c_custkey"
_SITE = f"(100 + {_K} % 60)::VARCHAR || ' ' || {_sql_pick(STREET, f'{_K} % 5')} || ' ' || {_sql_pick(KIND, f'({_K} // 7) % 4')}"

#: DuckDB definitions of the same tables, to be put after WITH.
CTES = {
    "parcels": f"""parcels AS (SELECT {_K} AS id, CASE WHEN {_K} % 97 != 0 THEN {_K} END AS objectid, c_nationkey AS county_id, c_name AS parcel_id, c_mktsegment AS classification,
      (-9520000 + ({_K} % 211) * 1700)::DOUBLE AS mx, (3560000 + ({_K} % 199) * 2100)::DOUBLE AS my, (20 + 10 * ({_K} % 5))::DOUBLE AS side,
      CASE WHEN {_K} % 41 = 0 THEN NULL WHEN {_K} % 43 = 0 THEN '' ELSE {_sql_pick(FIRST, f'{_K} % 7')} || ' ' || {_sql_pick(LAST, f'({_K} // 7) % 11')} || {_sql_pick(SUFFIX, f'{_K} % 7')} END AS owner_name,
      CASE WHEN {_K} % 37 = 0 THEN NULL WHEN {_K} % 31 = 0 THEN 'PO BOX ' || ({_K} % 9)::VARCHAR || ', MACON, GA 31201'
           ELSE {_SITE} || ', ' || {_sql_pick(CITY, f'{_K} % 4')} || ', GA ' || (30000 + {_K} % 25)::VARCHAR END AS owner_address,
      CASE WHEN {_K} % 53 = 0 THEN NULL ELSE ' ' || list_aggregate(list_transform(string_split({_SITE}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || '  ' END AS site_address,
      CASE WHEN {_K} % 50 = 7 THEN false END AS processed FROM customer)""",
    "parcel_taxes": "parcel_taxes AS (SELECT o_custkey AS parcel_id, year(o_orderdate)::INT AS tax_year, o_totalprice / 100 AS tax_amount, o_orderkey AS seq FROM orders)",
    "taxes": "taxes AS (SELECT parcel_id, tax_year, tax_amount FROM parcel_taxes QUALIFY row_number() OVER (PARTITION BY parcel_id, tax_year ORDER BY seq DESC) = 1)",
    "counties": """counties AS (SELECT n_nationkey AS county_id, n_name AS county_name, CASE WHEN r_name = 'AMERICA' THEN 'GA' ELSE 'XX' END AS state,
      -86 + 0.75::DOUBLE * (n_nationkey % 5) AS minx, 30.4::DOUBLE + 0.7::DOUBLE * (n_nationkey // 5) AS miny, -86 + 0.75::DOUBLE * (n_nationkey % 5) + 0.75::DOUBLE AS maxx, 30.4::DOUBLE + 0.7::DOUBLE * (n_nationkey // 5) + 0.7::DOUBLE AS maxy
      FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "class_codes": """class_codes AS (SELECT county_id, code, category, category = 'Residential' AS is_residential FROM (SELECT DISTINCT c_nationkey AS county_id, c_mktsegment AS code,
      CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Residential' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Commercial' ELSE 'Other' END AS category FROM customer WHERE c_nationkey % 7 <> 3))""",
    "lots": f"""places AS (SELECT c_custkey AS id, c_nationkey AS county_id, c_custkey % {LOT_ROW} AS i, c_custkey // {LOT_ROW} AS j FROM customer),
      lots AS (SELECT *, (i * 3 + j * 5) % 4 = 0 AS spike_s, (i * 3 + (j + 1) * 5) % 4 = 0 AS spike_n, (i * 5 + j * 3) % 4 = 0 AS spike_w, ((i + 1) * 5 + j * 3) % 4 = 0 AS spike_e,
        {_sql_border("i", "j", False)} AS bs, {_sql_border("i", "(j + 1)", False)} AS bn, {_sql_border("i", "j", True)} AS bw, {_sql_border("(i + 1)", "j", True)} AS be FROM places)""",
    "zip_areas": """zip_areas AS (SELECT (30000 + county_id)::VARCHAR AS zip5, minx - 0.04::DOUBLE AS minx, miny - 0.04::DOUBLE AS miny, maxx + 0.04::DOUBLE AS maxx, maxy + 0.04::DOUBLE AS maxy FROM counties WHERE county_id % 6 <> 5)""",
    "zip_cities": """zip_cities AS (SELECT (30000 + n_nationkey)::VARCHAR AS zip5, 'Town ' || n_nationkey AS city, n_nationkey % 3 = 0 AS is_preferred FROM nation WHERE n_nationkey % 8 <> 6
      UNION ALL SELECT (30000 + n_nationkey)::VARCHAR, 'Burg ' || n_nationkey, n_nationkey % 3 = 1 FROM nation WHERE n_nationkey % 8 <> 6)""",
}


def with_tables(names: str, query: str) -> str:
    """The DuckDB query over the named logical tables."""
    return f"WITH {', '.join(CTES[n] for n in names.split())} {query}"
