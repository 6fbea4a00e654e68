"""Write-once outputs: formatted TSV, BED, Parquet, JSON, and file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelab.operators.ordering import global_rank


def general_number(x: Column, digits: int = 12) -> Column:
    """Text of a double with that many significant digits, no trailing zeros, exponent only when needed.

    The digits are those of the exact binary value. The built-in formats round the shortest
    decimal text instead, which goes the other way where that text ends in a 5.
    """

    @F.pandas_udf(T.StringType())
    def text(values: pd.Series) -> pd.Series:
        # Adding 0.0 takes the sign off a zero.
        return pd.Series([None if v != v else f"{v + 0.0:.{digits}g}" for v in values.tolist()], dtype=object)

    return text(x)


def printable(df: DataFrame, columns: Sequence[str] | None = None, missing: str = "NA", digits: int = 12) -> DataFrame:
    """All columns as text: missing values as NA, booleans as 1/0, doubles in short form, arrays comma-joined."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in columns or df.columns:
        c, kind = F.col(name), kinds[name]
        if isinstance(kind, T.BooleanType):
            text = F.when(c, "1").otherwise("0")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            text = F.when(~F.isnan(c), general_number(c.cast("double"), digits))
        elif isinstance(kind, T.ArrayType):
            text = F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
        else:
            text = c.cast("string")
        out.append(F.when(c.isNull(), missing).otherwise(F.coalesce(text, F.lit(missing))).alias(name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, digits: int = 12, gzip: bool = True) -> None:
    """Header TSV part files; fails if the target exists."""
    writer = printable(df, columns, digits=digits).write.mode("errorifexists").option("sep", "\t").option("header", True)
    writer = writer.option("emptyValue", "").option("escape", '"')
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_bed(intervals: DataFrame, path: str, chrom: str = "chrom", start: str = "start0", end: str = "end0") -> None:
    """Sorted three-column intervals; file order follows the ranges."""
    ordered = intervals.select(chrom, start, end).repartitionByRange(chrom, start).sortWithinPartitions(chrom, start)
    ordered.write.mode("errorifexists").option("sep", "\t").csv(path)


def write_pool(pool: DataFrame, path: str, order: Sequence[str], flags: Sequence[str] = ("matched", "hard")) -> None:
    """Indexed pool: running id by a total order, files partitioned by the flags."""
    write_parquet(global_rank(pool, list(order), name="id"), path, flags)


def append_parquet(df: DataFrame, path: str) -> None:
    """More rows for a table that is there; other columns or types than it has are an error."""
    there = df.sparkSession.read.parquet(path).schema
    if {(f.name, f.dataType) for f in there} != {(f.name, f.dataType) for f in df.schema}:
        raise ValueError(f"{path} has the columns {there.simpleString()}, not {df.schema.simpleString()}")
    df.select(*there.names).write.mode("append").option("compression", "zstd").parquet(path)


def concatenate(spark: SparkSession, paths: Sequence[str], path: str) -> None:
    """Several Parquet tables into one, by column name."""
    out = None
    for p in paths:
        part = spark.read.parquet(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    write_parquet(out, path)


def file_digests(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 8 << 20) -> DataFrame:
    """(path, length, sha256) of the files below a folder, each streamed in chunks by a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    listed = files.load(path).select("path", "length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch["path"]:
                system, name = fs.FileSystem.from_uri(uri)
                state = hashlib.sha256()
                with system.open_input_stream(name) as handle:
                    while block := handle.read(chunk):
                        state.update(block)
                out.append(state.hexdigest())
            yield batch.assign(sha256=out)

    return listed.mapInPandas(digest, "path string, length bigint, sha256 string")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare (path, sha256) with a manifest: match, differs, missing or unlisted."""
    joined = manifest.select("path", F.col("sha256").alias("_want")).join(
        files.select("path", F.col("sha256").alias("_got")), "path", "full"
    )
    state = (
        F.when(F.col("_got").isNull(), "missing")
        .when(F.col("_want").isNull(), "unlisted")
        .when(F.col("_got") != F.col("_want"), "differs")
        .otherwise("match")
    )
    return joined.select("path", state.alias("state"))
