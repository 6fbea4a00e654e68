"""Ranks and running aggregates over whole tables or huge groups.

A window without ``partitionBy`` (or over a handful of model ids or chromosomes)
would pull everything through a few tasks. Here the rows are range-partitioned
on (group, order), so that a group of any size spreads over many tasks; each
range keeps one small summary, and the summaries are combined.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelab.session import cut

BUCKET = "_bucket"


def sort_exprs(order: Sequence[str], reverse: bool = False) -> list[Column]:
    """``"-score"`` sorts descending, ``"id"`` ascending; ``reverse`` turns the whole order round."""
    return [
        F.col(c.lstrip("-")).desc() if c.startswith("-") != reverse else F.col(c.lstrip("-")).asc() for c in order
    ]


def _by_bucket(rows: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the summary of (by, bucket); a NULL group is a group like any other."""
    keys = [*by, BUCKET]
    values = [c for c in summary.columns if c not in keys]
    named = summary.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *values)
    same = F.col(BUCKET) == F.col(f"_g{len(by)}")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(named, same).drop(*[f"_g{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based row number by ``order`` (a total order) within ``by``; one range shuffle."""
    by = list(by)
    layout = [F.col(c).asc() for c in by] + sort_exprs(order)
    laid = df.repartitionByRange(*layout).sortWithinPartitions(*layout)
    laid = cut(laid.withColumn("_slot", F.monotonically_increasing_id()))
    # The id holds the partition number above bit 33 and the position below it.
    laid = laid.withColumn(BUCKET, F.shiftright("_slot", 33))
    runs = laid.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_first"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = _by_bucket(laid, runs, by)
    rank = (F.col("_slot") - F.col("_first") + F.col("_before") + 1).cast("bigint")
    return joined.select(*df.columns, rank.alias(name))


@dataclass(frozen=True)
class Scan:
    """A running aggregate: ``kind`` is sum, min or max.

    ``reverse`` runs from the last row, ``exclusive`` leaves the row itself out,
    ``whole`` aggregates the group.
    """

    kind: str
    column: str | Column
    reverse: bool = False
    exclusive: bool = False
    whole: bool = False


_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


class Ordered:
    """A table laid out by (by, order); ``scan`` adds running aggregates to it."""

    def __init__(self, df: DataFrame, order: Sequence[str], by: Sequence[str] = (), _laid: bool = False):
        self.by = list(by)
        self.order = list(order)
        if _laid:
            self._df = df
        else:
            layout = [F.col(c).asc() for c in self.by] + sort_exprs(self.order)
            placed = df.repartitionByRange(*layout).withColumn(BUCKET, F.spark_partition_id())
            self._df = cut(placed)

    def scan(self, **scans: Scan) -> Ordered:
        keys = [*self.by, BUCKET]
        df = self._df
        values = {name: (F.col(s.column) if isinstance(s.column, str) else s.column) for name, s in scans.items()}
        totals = df.groupBy(*keys).agg(
            *[_AGGREGATE[s.kind](values[name]).alias(f"_t_{name}") for name, s in scans.items()]
        )
        across = Window.partitionBy(*(self.by or [F.lit(0)])).orderBy(BUCKET)
        # A frame that ends at the last row costs quadratic time, so reverse scans
        # sort the bucket the other way and look back.
        forward = Window.partitionBy(*keys).orderBy(*sort_exprs(self.order))
        backward = Window.partitionBy(*keys).orderBy(*sort_exprs(self.order, reverse=True))
        local, outside = {}, {}
        for name, s in scans.items():
            aggregate = _AGGREGATE[s.kind]
            if s.whole:
                far = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            elif s.reverse:
                far = across.rowsBetween(1, Window.unboundedFollowing)
            else:
                far = across.rowsBetween(Window.unboundedPreceding, -1)
            outside[name] = aggregate(f"_t_{name}").over(far).alias(f"_f_{name}")
            if not s.whole:
                near = (backward if s.reverse else forward).rowsBetween(
                    Window.unboundedPreceding, -1 if s.exclusive else 0
                )
                local[name] = aggregate(values[name]).over(near).alias(f"_n_{name}")
        totals = totals.select(*keys, *outside.values())
        df = _by_bucket(df.select("*", *local.values()), totals, self.by)
        kept = [F.col(c) for c in self._df.columns if c not in scans]
        added = [
            (
                F.col(f"_f_{name}") if s.whole else _combine(s.kind, F.col(f"_n_{name}"), F.col(f"_f_{name}"))
            ).alias(name)
            for name, s in scans.items()
        ]
        return Ordered(df.select(*kept, *added), self.order, self.by, _laid=True)

    def with_column(self, name: str, value: Column) -> Ordered:
        return Ordered(self._df.withColumn(name, value), self.order, self.by, _laid=True)

    def frame(self) -> DataFrame:
        return self._df.drop(BUCKET)


#: Cells into which the values of a numeric order column are counted.
CELLS = 4096
#: Rows that are ranked without being narrowed further.
FEW = 100_000
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _common(a: str, b: str) -> int:
    """Length of the common start of two texts."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _first_cells(counts: list[tuple], k: int) -> tuple[list, object, int]:
    """(cells taken whole, the cell that reaches k, rows before it) of counted cells in order."""
    whole, total = [], 0
    for cell, n in counts:
        if total + n >= k:
            return whole, cell, total
        whole.append(cell)
        total += n
    return whole, None, total


def top_k(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """The first k rows by a total order, by one way at every k and size.

    The first column is counted in cells: numbers in CELLS of equal width, texts by the
    shortest start that tells any of them apart. Cells before the one that reaches k are
    taken whole, later ones go, and the cell at the edge is counted again in finer cells,
    until few rows are left or all have one value; then the next column decides among
    them. Only what is left is ranked.
    """
    lead, down = order[0].lstrip("-"), order[0].startswith("-")
    kind = dict(df.dtypes)[lead]
    if k <= 0:
        return df.filter("false")
    if len(order) == 1 or kind not in (*NUMBERS, "string"):
        return _ranked_first(df, k, order)
    taken, edge, left = [], df, k
    while True:
        low, high, n, missing = edge.agg(F.min(lead), F.max(lead), F.count(lead), F.count_if(F.col(lead).isNull())).first()
        if n + missing <= max(FEW, left):
            taken.append(_ranked_first(edge, left, order))
            break
        if not n or (not missing and low == high):
            # One value: the next column decides.
            taken.append(top_k(edge, left, order[1:]))
            break
        if kind == "string":
            cell = F.substring(lead, 1, _common(low, high) + 1)
        elif math.isfinite(low) and math.isfinite(high) and float(high) > float(low):
            share = (F.col(lead).cast("double") - float(low)) / (float(high) - float(low))
            # The smaller of NULL and a number would be the number.
            cell = F.when(share.isNotNull(), F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        else:
            taken.append(_ranked_first(edge, left, order))
            break
        found = edge.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        values = sorted(((r["c"], r["n"]) for r in found if r["c"] is not None), reverse=down)
        # NULL comes last in a descending order and first in an ascending one.
        none = [(None, missing)] if missing else []
        whole, at, before = _first_cells([*values, *none] if down else [*none, *values], left)
        if None in whole:
            taken.append(edge.filter(F.col(lead).isNull()))
        if kept := [c for c in whole if c is not None]:
            taken.append(edge.filter(cell <= kept[-1]) if not down else edge.filter(cell >= kept[-1]))
        edge, left = edge.filter(cell == at) if at is not None else edge.filter(F.col(lead).isNull()), left - before
    return functools.reduce(lambda a, b: a.unionByName(b), taken)


def _ranked_first(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    return global_rank(df, order, name="_rank").filter(F.col("_rank") <= k).drop("_rank")
