"""Queries over training corpora and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("url_filters", "secrets", "decontamination", "suffix_dedup", "pii", "media", "near_duplicates", "languages", "quality", "mixing", "prefix_trie", "conversation_repair", "html_text")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"landloom.llm.{name}"), attribute)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES") | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
