"""Ranks and running totals without one task for a group: rows are cut by ranges, counted, and offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.operators.staging import staged


def running_totals(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the sum of each column (whole numbers) over its group's rows up to this one, by `order` (nulls first).

    Rows are cut into ranges of (group, order) and written with their range's number.
    A window runs within a range; the few groups that a border cuts (at most one for each border) are known from
    their totals a range, which are broadcast: at most two rows for each range. Which of equal rows comes first is left open.
    Null group columns are a group of their own. No rows give no rows.
    """
    told = rows.withColumns({f"_{name}": value for name, value in sums.items()})
    cut = staged(told.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*group, *order)]).withColumn("_range", F.spark_partition_id()))
    by_range = cut.groupBy(*group, "_range").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    spanned = by_range.withColumn("_ranges", F.count("*").over(Window.partitionBy(*group))).where("_ranges > 1")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spanned.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums])
    inside = Window.partitionBy("_range", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({name: F.sum(f"_{name}").over(inside) for name in sums})
    same = F.col("_range") == F.col("_at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = local.join(F.broadcast(offsets), same, "left")
    return joined.select(*rows.columns, *[(F.col(name) + F.coalesce(f"_o_{name}", F.lit(0))).alias(name) for name in sums])


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """rows with their number (from 1) in their group by `order`, nulls first."""
    return running_totals(rows, group, order, {name: F.lit(1).cast("long")})


def exact_percentiles(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """group and p (array, one for each share) of the values that are not null, between neighbours by straight lines.

    Values are ranked by ranges; only the one or two rows that a share falls on go on, so no task holds a group's values.
    """
    held = ranked(rows.where(F.col(value).isNotNull()).select(*group, value), group, [value])
    counts = staged(held.groupBy(*group).agg(F.max("nth").alias("n")))
    places = counts.select(*group, "n", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("_i", "_share"))
    at = (F.col("n") - 1) * F.col("_share") + 1
    sought = places.select(*group, "_i", at.alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("nth"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "nth")]
    found = held.alias("l").join(sought.alias("r"), same).select(*[f"r.{c}" for c in group], "_i", "_at", "r.nth", F.col(f"l.{value}").alias("_v"))
    low, high = F.min_by("_v", "nth"), F.max_by("_v", "nth")
    each = found.groupBy(*group, "_i").agg((low + (high - low) * (F.first("_at") - F.min("nth"))).alias("_p"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda s: s["_p"]).alias("p"))


def paged(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """rows with nth (from 1) in their group, page (from 1) and pages of their group. Any page is a slice of a range of (group, order)."""
    held = staged(ranked(rows, group, order))
    counts = held.groupBy(*group).agg(F.ceil(F.max("nth") / size).alias("pages"))
    joined = held.join(counts, group) if group else held.crossJoin(F.broadcast(counts))  # one row
    return joined.withColumn("page", F.ceil(F.col("nth") / size))


def keyset_bounds(rows: DataFrame, key: str, size: int) -> DataFrame:
    """page, first_key, last_key, n of pages of so many rows by a unique key: page k is asked for as the rows with last_key(k - 1) < key <= last_key(k)."""
    return ranked(rows.where(F.col(key).isNotNull()).select(key), [], [key]).groupBy(F.ceil(F.col("nth") / size).alias("page")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))
