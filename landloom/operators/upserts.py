"""Upserts and partial updates as joins and windows; results are whole new tables to be written by the caller."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole(keys: list[str]) -> Column:
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return whole


def _spread(rows: DataFrame, keys: list[str]) -> Column:
    """A hash of a row whose key has a null, so that such rows, which all stay, don't meet in one task; null for others."""
    plain = [f.name for f in rows.schema.fields if not re.search(r"map<|variant", f.dataType.simpleString())]
    return F.when(~_whole(keys), F.xxhash64(*plain))


def last_write_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key; rows with a null in the key never conflict and all stay. What feeds it runs once."""
    by = Window.partitionBy(*keys, _spread(rows, keys)).orderBy(F.col(order).desc())
    return rows.withColumn("_nth", F.row_number().over(by)).where((F.col("_nth") == 1) | ~_whole(keys)).drop("_nth")


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of either side; where both have a key, the listed columns come from new and the others from old."""
    a, b = old.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    joined = a.alias("o").join(b.alias("n"), keys, "full")
    rest = [c for c in old.columns if c not in keys]
    pick = lambda c: F.when(F.col("_new") if c in columns else F.col("_old").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in rest])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """old with the rows of new whose key it has not. Of several new rows of a key the first by `order` stays (by a hash of the row if none is
    named, so that reruns agree); rows with a null in the key never conflict and all go in."""
    plain = [f.name for f in new.schema.fields if not re.search(r"map<|variant", f.dataType.simpleString())]
    first = [F.col(c) for c in order or []] + [F.xxhash64(*plain)]
    one = new.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, _spread(new, keys)).orderBy(*first))).where((F.col("_nth") == 1) | ~_whole(keys)).drop("_nth")
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def update_non_empty(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: str | None = None, stamp: tuple[str, Column] | None = None) -> DataFrame:
    """old, with the listed columns set where new has a value that is not empty. Of several new rows of a key the last value by `order` that is not empty counts
    (the greatest without an order), so each old row stays one. stamp: a column of old, and what it becomes where something was set (last_sync)."""
    value = lambda c: F.nullif(F.col(c), F.lit(""))
    of = lambda c: F.max_by(value(c), F.when(value(c).isNotNull(), F.col(order))) if order else F.max(value(c))
    right = new.where(_whole(keys)).groupBy(*keys).agg(*[of(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(right, keys, "left")
    told = F.coalesce(*[F.col(f"_new_{c}") for c in columns]).isNotNull()

    def column(c: str) -> Column:
        if c in columns:
            return F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
        return F.when(told, stamp[1]).otherwise(F.col(c)).alias(c) if stamp and c == stamp[0] else F.col(c)

    return joined.select(*map(column, old.columns))
