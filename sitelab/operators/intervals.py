"""Half-open intervals and points: merge, subtract, cluster, overlap, proximity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelab.operators.ordering import Ordered, Scan

BIN = 1 << 14
FINE_BIN = 1 << 10
HALO_BIN = 1 << 20


def merge_intervals(df: DataFrame, by: Sequence[str], start: str = "start0", end: str = "end0") -> DataFrame:
    """Union of the intervals per group; touching ones join."""
    by = list(by)
    # One interval per start is enough, so a popular start costs one row.
    longest = df.groupBy(*by, start).agg(F.max(end).alias(end))
    islands = (
        Ordered(longest, [start], by)
        .scan(_reach=Scan("max", end, exclusive=True))
        .with_column(
            "_opens", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
        )
        .scan(_island=Scan("sum", "_opens"))
        .frame()
    )
    return (
        islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    )


def subtract_intervals(
    source: DataFrame, blockers: DataFrame, by: Sequence[str], start: str = "start0", end: str = "end0"
) -> DataFrame:
    """What of the source no blocker covers: a boundary sweep with running depths."""
    by = list(by)

    def edges(df: DataFrame, column: str) -> DataFrame:
        zero = F.lit(0)
        marks = F.array(
            *[
                F.struct(
                    F.col(at).alias("_at"),
                    (F.lit(step) if column == "_s" else zero).alias("_s"),
                    (F.lit(step) if column == "_b" else zero).alias("_b"),
                )
                for at, step in ((start, 1), (end, -1))
            ]
        )
        return df.select(*by, F.inline(marks))

    steps = (
        edges(source, "_s")
        .unionByName(edges(blockers, "_b"))
        .groupBy(*by, "_at")
        .agg(F.sum("_s").alias("_s"), F.sum("_b").alias("_b"))
    )
    swept = (
        Ordered(steps, ["_at"], by)
        .scan(
            _in=Scan("sum", "_s"),
            _out=Scan("sum", "_b"),
            _next=Scan("min", "_at", reverse=True, exclusive=True),
        )
        .frame()
        .filter((F.col("_in") > 0) & (F.col("_out") == 0))
    )
    pieces = swept.select(*by, F.col("_at").alias(start), F.col("_next").alias(end))
    return merge_intervals(pieces, by, start, end)


def unambiguous_strands(df: DataFrame, chrom: str = "chrom", strand: str = "strand") -> DataFrame:
    """Intervals covered on one strand only, with that strand."""
    plus, minus = df.filter(F.col(strand) == "+"), df.filter(F.col(strand) == "-")
    only_plus = subtract_intervals(plus, minus, [chrom]).withColumn(strand, F.lit("+"))
    only_minus = subtract_intervals(minus, plus, [chrom]).withColumn(strand, F.lit("-"))
    return only_plus.unionByName(only_minus)


def cluster_points(df: DataFrame, by: Sequence[str], position: str, gap: int = 200) -> DataFrame:
    """Clusters of distinct positions whose neighbours are at most ``gap`` apart."""
    by = list(by)
    islands = (
        Ordered(df.select(*by, position).distinct(), [position], by)
        .scan(_previous=Scan("max", position, exclusive=True))
        .with_column(
            "_opens",
            F.when(F.col("_previous").isNull() | (F.col(position) - F.col("_previous") > gap), 1).otherwise(0),
        )
        .scan(cluster_id=Scan("sum", "_opens"))
        .frame()
    )
    return islands.groupBy(*by, "cluster_id").agg(
        F.min(position).alias("cluster_start"),
        (F.max(position) + 1).alias("cluster_end"),
        F.count(F.lit(1)).alias("members"),
    )


def first_bases(df: DataFrame, by: Sequence[str], limit: int, start: str = "start0", end: str = "end0") -> DataFrame:
    """Intervals in order until ``limit`` bases are taken; the last one is trimmed."""
    taken = Ordered(df, [start], by).scan(_before=Scan("sum", F.col(end) - F.col(start), exclusive=True)).frame()
    left = F.lit(limit) - F.coalesce("_before", F.lit(0))
    kept = taken.filter(left > 0)
    return kept.withColumn(end, F.least(F.col(end), F.col(start) + left)).drop("_before")


def previous_position(
    points: DataFrame, by: Sequence[str], position: str, distance: int, name: str = "previous"
) -> DataFrame:
    """For distinct points: the nearest smaller position within ``distance``, else NULL.

    Windows run over fixed stretches of the axis, so a long chromosome is many
    tasks; the points near the end of a stretch are shown to the next one too.
    """
    width = max(HALO_BIN, distance)
    stretch = F.floor(F.col(position) / width)
    late = F.col(position) - stretch * width >= width - distance
    shown = points.select(
        "*",
        F.explode(F.when(late, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))).alias("_stretch"),
    )
    w = Window.partitionBy(*by, "_stretch").orderBy(position)
    before = shown.withColumn("_p", F.lag(position).over(w)).filter(F.col("_stretch") == stretch)
    near = F.col(position) - F.col("_p") <= distance
    return before.select(*points.columns, F.when(near, F.col("_p")).alias(name))


def neighbour_pairs(points: DataFrame, by: Sequence[str], position: str, distance: int = 100) -> DataFrame:
    """Adjacent distinct positions at most ``distance`` apart."""
    distinct = points.select(*by, position).distinct()
    return previous_position(distinct, by, position, distance).filter(F.col("previous").isNotNull())


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    position: str,
    start: str = "start0",
    end: str = "end0",
    width: int = BIN,
) -> DataFrame:
    """All (point, interval) hits with start <= position < end, by an equi-join on bins."""
    by = list(by)
    p = points.withColumn("_bin", F.floor(F.col(position) / width))
    q = intervals.withColumn(
        "_bin",
        F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))),
    )
    hit = (F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))
    return p.join(q, [*by, "_bin"]).filter(hit).drop("_bin")


def covering_values(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    position: str,
    ids: Sequence[str],
    start: str = "start0",
    end: str = "end0",
    width: int = FINE_BIN,
) -> DataFrame:
    """Points within an interval, with the sorted distinct ids of the intervals around them and their number ``hits``.

    A point never meets the intervals one by one: those of one id are merged first, so that
    a point lies in at most one of them, and the number is a running sum of starts and ends.
    Both are cut at fixed bins of the axis and stand in one row per bin, to which the points
    are joined; no row per point and interval comes into being.
    """
    by = list(by)
    real = intervals.filter(F.col(start) < F.col(end))
    bins = lambda first, last: F.explode(F.sequence(first, last))
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    # Those that began in an earlier bin, then every start and end within the bin.
    crossing = real.filter(last > first).select(*by, bins(first + 1, last).alias("_bin"))
    crossing = crossing.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_base"))
    begins = real.select(*by, F.col(start).cast("bigint").alias("_at"), F.lit(1).cast("bigint").alias("_n"))
    ends = real.filter(F.col(end) % width != 0).select(*by, F.col(end).cast("bigint").alias("_at"), F.lit(-1).cast("bigint").alias("_n"))
    steps = begins.unionByName(ends).groupBy(*by, "_at").agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    parts = crossing.unionByName(
        steps.select(*by, F.floor(F.col("_at") / width).alias("_bin"), F.struct("_at", "_n").alias("_step")), allowMissingColumns=True
    )
    for i, name in enumerate(ids):
        merged = merge_intervals(real.filter(F.col(name).isNotNull()), [*by, name], start, end)
        piece = F.struct(F.col(name).alias("value"), F.col(start).alias("from"), F.col(end).alias("to")).alias(f"_v{i}")
        parts = parts.unionByName(merged.select(*by, bins(first, last).alias("_bin"), piece), allowMissingColumns=True)
    table = parts.groupBy(*by, "_bin").agg(
        F.coalesce(F.sum("_base"), F.lit(0)).alias("_base"),
        F.collect_list("_step").alias("_steps"),
        *[F.array_sort(F.collect_list(f"_v{i}")).alias(f"_v{i}") for i in range(len(ids))],
    )
    joined = points.withColumn("_bin", F.floor(F.col(position) / width)).join(table, [*by, "_bin"])
    at = F.col(position)

    def names(pieces: str) -> Column:
        around = F.filter(pieces, lambda v: (v["from"] <= at) & (at < v["to"]))
        return F.array_join(F.transform(around, lambda v: v["value"]), ",")

    moved = F.aggregate("_steps", F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["_at"] <= at, x["_n"]).otherwise(F.lit(0)))
    counted = joined.withColumn("hits", F.col("_base") + moved).filter("hits > 0")
    return counted.select(*points.columns, *[names(f"_v{i}").alias(name) for i, name in enumerate(ids)], "hits")


def near_centres(
    points: DataFrame, centres: DataFrame, by: Sequence[str], position: str, distance: int
) -> DataFrame:
    """Distinct (by, position) of the points that have a centre within ``distance``.

    Both sides are reduced to distinct positions first. Within a stretch of the
    axis the nearest centre on either side is a running max / min, so no point
    is paired with all centres around it.
    """
    by = list(by)
    width = max(HALO_BIN, distance)
    marks = (
        points.select(*by, F.col(position).alias("_at"), F.lit(1).alias("_p"), F.lit(0).alias("_c"))
        .unionByName(centres.select(*by, F.col(position).alias("_at"), F.lit(0).alias("_p"), F.lit(1).alias("_c")))
        .groupBy(*by, "_at")
        .agg(F.max("_p").alias("_p"), F.max("_c").alias("_c"))
    )
    home = F.floor(F.col("_at") / width)
    reach = F.sequence(F.floor((F.col("_at") - distance) / width), F.floor((F.col("_at") + distance) / width))
    shown = marks.withColumn("_stretch", F.explode(F.when(F.col("_c") == 1, reach).otherwise(F.array(home))))
    stretch = Window.partitionBy(*by, "_stretch")
    so_far = (Window.unboundedPreceding, 0)
    centre = F.when(F.col("_c") == 1, F.col("_at"))
    left = F.max(centre).over(stretch.orderBy("_at").rowsBetween(*so_far))
    # Looking back in descending order; a frame to the last row would be quadratic.
    right = F.min(centre).over(stretch.orderBy(F.desc("_at")).rowsBetween(*so_far))
    scanned = shown.select(*by, "_at", "_p", "_stretch", left.alias("_l"), right.alias("_r"))
    close = (F.col("_at") - F.col("_l") <= distance) | (F.col("_r") - F.col("_at") <= distance)
    return (
        scanned.filter((F.col("_p") == 1) & (F.col("_stretch") == F.floor(F.col("_at") / width)) & close)
        .select(*by, F.col("_at").alias(position))
    )
