"""Queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("taxes", "tiles", "owners", "places", "activity", "loads", "search", "queue", "shapes")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-zoom tax heatmap."""
    return queries()["q15_tax_heatmap"](spark, sf_dir)


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"landloom.plans.{name}"), attribute)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
