"""Publication gate: a table appears under its path only if every assertion about it holds.

The rows are written once, to a folder beside the target. Rules about single rows, and the
number of rows, are counted while they are written (``DataFrame.observe``); uniqueness is
counted on what was written. Only if nothing is violated is the folder renamed to the
target; otherwise it goes, and nothing is published. The assertions lie in the published
folder under ``_assertions``, which readers of the table pass over.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from sitelab.operators.ordering import global_rank


class Refused(RuntimeError):
    """Assertions that failed: rows of (assertion, status, violations)."""

    def __init__(self, failed: list[Row]):
        super().__init__("; ".join(f"{r['assertion']}: {r['violations']} violations" for r in failed))
        self.failed = failed


def require_columns(df: DataFrame, needed: Sequence[str], what: str = "table") -> None:
    """All columns that a reader of the table counts on."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _verdict(assertion: str, violations: int) -> Row:
    return Row(assertion=assertion, status="FAIL" if violations else "PASS", violations=int(violations))


def publish(
    df: DataFrame,
    path: str,
    rules: dict[str, Column] | None = None,
    unique: Sequence[str] = (),
    required: Sequence[str] = (),
    expected: int | None = None,
    suite: DataFrame | None = None,
    partition_by: Sequence[str] = (),
) -> list[Row]:
    """Write ``df`` to ``path`` if all holds, else raise ``Refused`` and leave nothing.

    ``rules`` are true for a bad row (NULL is bad too); ``unique`` names columns that
    together occur once and are never NULL; ``expected`` is a number of rows; ``suite`` is
    a table of assertions about other tables that have to hold as well. Returns all
    assertions as (assertion, status, violations).
    """
    spark = df.sparkSession
    require_columns(df, [*required, *unique, *partition_by])
    target, system = _path(spark, path)
    if system.exists(target):
        raise FileExistsError(path)
    staging, _ = _path(spark, f"{path}.staging-{uuid.uuid4().hex}")
    system.deleteOnExit(staging)
    seen = Observation()
    bad = {name: F.count_if(F.coalesce(rule, F.lit(True))) for name, rule in (rules or {}).items()}
    counts = [F.count(F.lit(1)).alias("rows"), *[c.alias(f"r{i}") for i, c in enumerate(bad.values())]]
    try:
        df.observe(seen, *counts).write.option("compression", "zstd").partitionBy(*partition_by).parquet(str(staging))
        found = [_verdict(name, seen.get[f"r{i}"]) for i, name in enumerate(bad)]
        if expected is not None:
            found.append(_verdict("number_of_rows_as_expected", abs(seen.get["rows"] - expected)))
        if unique:
            written = spark.read.schema(df.schema).parquet(str(staging))
            missing = F.greatest(*[F.col(c).isNull().cast("int") for c in unique], F.lit(0))
            keys = written.groupBy(*unique).agg(F.count(F.lit(1)).alias("n"), F.max(missing).alias("m"))
            over = keys.agg(F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("v"))
            found.append(_verdict("key_is_unique", over.first()["v"]))
        if suite is not None:
            found += [_verdict(r["assertion"], r["violations"]) for r in suite.collect()]
        failed = [r for r in found if r["status"] != "PASS"]
        if failed:
            raise Refused(failed)
        if found:
            spark.createDataFrame(found, "assertion string, status string, violations long").coalesce(1).write.json(f"{staging}/_assertions")
        if not system.rename(staging, target):
            raise FileExistsError(path)
    finally:
        # After the rename there is nothing left under the staging name.
        system.delete(staging, True)
    return found


def publish_pool(pool: DataFrame, path: str, order: Sequence[str], key: str, flags: Sequence[str] = ("matched", "hard"), **checks) -> list[Row]:
    """Indexed pool: a unique key, a running id by a total order, files partitioned by the flags."""
    return publish(global_rank(pool, list(order), name="row_id"), path, unique=[key], partition_by=flags, **checks)
