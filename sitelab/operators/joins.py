"""Flags, exclusions and checked lookups by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_positions(df: DataFrame, positions: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Boolean column: the row's key occurs among the positions (allele is ignored)."""
    seen = positions.select(*on).distinct().withColumn("_seen", F.lit(True))
    return (
        df.join(seen, list(on), "left").withColumn(name, F.col("_seen").isNotNull()).drop("_seen")
    ).select(*df.columns, name)


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def annotate(df: DataFrame, annotations: DataFrame, on: Sequence[str], fill: str = "NA") -> DataFrame:
    """Left join of text annotations, unmatched ones filled."""
    extra = [c for c in annotations.columns if c not in on]
    joined = df.join(annotations, list(on), "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in extra])


def compare_labels(new: DataFrame, old: DataFrame, on: Sequence[str], new_flag: str, old_flag: Column) -> DataFrame:
    """Old and new decision side by side; a key without an old row counts as not positive."""
    joined = new.select(*on, new_flag).join(old.select(*on, old_flag.alias("old_positive")), list(on), "left")
    was = F.coalesce("old_positive", F.lit(False))
    return joined.select(
        *on, was.alias("old_positive"), F.col(new_flag).alias("new_positive"), was.eqNullSafe(F.col(new_flag)).alias("agreement")
    )


def checked_lookup(df: DataFrame, scores: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Join a stored value to every row; a row without one is an error, raised in the task."""
    joined = df.join(scores.select(*on, value), list(on), "left")
    message = F.concat(F.lit("no stored value for key "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))
    safe = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.raise_error(message).cast("double"))
    return joined.withColumn(value, safe)
