"""Queries of the training-data operators and their SQL, kept apart from the rest of the library."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = (
    "near_dedup",
    "language_crf",
    "jaccard_join",
    "decision_list",
    "warc",
    "mixing",
    "pieces",
    "quality_kernel",
    "line_spread",
    "personal_data",
    "license_scan",
    "hard_negatives",
    "token_alignment",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"sitelab.llm.{name}")
