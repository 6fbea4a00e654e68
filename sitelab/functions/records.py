"""One record shape from tables with aliases, gaps and text sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.functions.sequences import base_count, base_entropy, gc_fraction, sequence_hash

SENTINELS = ("", "NA", "-", "nan", "NaN")


def real_text(column: Column) -> Column:
    """NULL instead of a missing-value text."""
    return F.when(~column.isin(*SENTINELS), column)


def number(column: Column) -> Column:
    return F.nanvl(real_text(column.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def normalise(df: DataFrame) -> DataFrame:
    """Fill what a record lacks: depth from samples, coverage from depth, measures from the sequence."""

    def first(*names: str) -> Column:
        found = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*found) if found else F.lit(None)

    def first_number(*names: str) -> Column:
        found = [number(F.col(n)) for n in names if n in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    seq = F.col("sequence_context")
    depth = F.coalesce(first_number("median_depth"), first_number("sample_median_depth"), F.lit(0.0))
    kind = F.when(F.col("label") == 1, "positive").otherwise("random_strict")
    filled = {
        "negative_type": F.coalesce(real_text(first("negative_type", "negative_difficulty").cast("string")), kind),
        "median_depth": depth,
        "gene_coverage": F.coalesce(first_number("gene_level_coverage", "gene_coverage"), depth),
        "true_efficiency": F.coalesce(first_number("true_efficiency", "corrected_editing_efficiency"), F.lit(0.0)),
        "gc_fraction": F.coalesce(first_number("gc_fraction"), gc_fraction(seq)),
        "c_count": F.coalesce(first_number("c_count").cast("bigint"), base_count(seq, "C").cast("bigint")),
        "entropy": F.coalesce(first_number("entropy", "sequence_entropy_log2_single_base_101nt"), base_entropy(seq)),
        "sequence_hash": F.coalesce(first("sequence_hash").cast("string"), sequence_hash(seq)),
    }
    return df.withColumns(filled)


def known_genes(genes: str | Column) -> Column:
    """Names of genes without missing ones, whether NULL or a placeholder; they are no shared gene."""
    genes = F.col(genes) if isinstance(genes, str) else genes
    return F.filter(F.coalesce(genes, F.array()), lambda g: g.isNotNull() & ~g.isin("", "NA", "-"))
