"""Best rows and multiplicities per key, balanced when single keys hold a large share of the rows.

Both aggregate on the map side; the join back is a plain equi-join whose hot keys the
adaptive skew join splits by their measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the first in ``order``, by partial aggregation.

    Replaces ``row_number() = 1`` over the key: a hot key is reduced on the map
    side, so no task ever sorts its whole group. A NULL in the order comes last.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(*[c for i, o in enumerate(order) for c in (o.isNull().alias(f"_n{i}"), o.alias(f"_o{i}"))], F.struct(*rest).alias("_row")))
    picked = df.groupBy(*key).agg(best.alias("_best"))
    return picked.select(*key, *[F.col("_best._row")[c].alias(c) for c in rest]).select(*df.columns)


def key_counts(df: DataFrame, key: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))


def with_key_count(df: DataFrame, key: Sequence[str], name: str = "key_count") -> DataFrame:
    """Multiplicity of each row's key, safe for a key that holds most rows; NULL counts as a value."""
    keys = [f"_on{i}" for i in range(len(key))]
    counts = key_counts(df, key, name).select(*[F.col(c).alias(k) for c, k in zip(key, keys, strict=True)], name)
    same = F.lit(True)
    for c, k in zip(key, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return df.join(counts, same).select(*df.columns, name)
