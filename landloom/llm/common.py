"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.operators.staging import staged


__all__ = ["bounded_sample", "read", "staged", "text_of"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def share_of(bound: int, n: int) -> int:
    """Below which of 2^63 numbers a hash must lie for about `bound` of n rows to be chosen."""
    return (bound << 63) // n


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """Different rows of df, about `bound` of them at most, chosen by a hash of the key and the row, the same on every run.

    Rows of one key are chosen apart and equal rows count once, so that no repeated key or row exceeds the bound. The
    hash has 63 bits, so the share does not vanish on any corpus."""
    n = df.count()
    if n > bound:
        df = df.where(F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed), *df.columns), 1) < share_of(bound, n))
    return df.dropDuplicates()
