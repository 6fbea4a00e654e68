"""Registered queries: a Spark callable and, where SQL can state it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sitelab.plans.views import oracle, view


class Source:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(source) -> DataFrame`` under a name."""

    def add(fn: Callable[[Source], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(
            run=lambda spark, sf_dir: fn(Source(spark, sf_dir)), sql=oracle(sql) if sql else None
        )
        return fn

    return add
