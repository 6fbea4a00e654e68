"""Multiple testing, rank correlation, quantiles and summaries over seeds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.operators.ordering import Ordered, Scan


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "fdr") -> DataFrame:
    """Adjusted p-values; NULL stays NULL.

    Equal p-values share one adjusted value, so the running minimum works on the
    distinct values only, laid out over many tasks.
    """
    by = list(by)
    distinct = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    ladder = (
        Ordered(distinct, [p], by)
        .scan(_rank=Scan("sum", "_n"), _all=Scan("sum", "_n", whole=True))
        .scan(_q=Scan("min", F.col(p) * F.col("_all") / F.col("_rank"), reverse=True))
        .frame()
        .select(*by, p, "_n", F.least(F.col("_q"), F.lit(1.0)).alias(name))
    )
    tested = df.filter(F.col(p).isNotNull()).join(ladder, [*by, p]).drop("_n")
    untested = df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    return tested.select(*df.columns, name).unionByName(untested)


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "average_rank") -> DataFrame:
    """Ascending rank with ties sharing their mean rank."""
    by = list(by)
    distinct = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    table = (
        Ordered(distinct, [value], by)
        .scan(_below=Scan("sum", "_n", exclusive=True))
        .frame()
        .select(*by, value, "_n", (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    )
    return df.join(table, [*by, value]).select(*df.columns, name)


def correlations(df: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns per group."""
    ranked = average_rank(average_rank(df, left, by, "_rl"), right, by, "_rr")
    return ranked.groupBy(*by).agg(
        F.corr(left, right).alias("pearson"), F.corr("_rl", "_rr").alias("spearman")
    )


#: Terms of the continued fraction of the incomplete beta function, and the shortest tail it is run on.
BETA_TERMS = 200
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by ten."""
    shift = sum(F.log(x + i) for i in range(10))
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, term by term from the front."""

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def advance(state: Column, step: Column) -> Column:
        moved = _let(
            state, lambda s: F.struct(away(1 + step / s["c"]).alias("c"), (1 / away(1 + step * s["d"])).alias("d"), s["h"].alias("h"))
        )
        return _let(moved, lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h")))

    def term(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return advance(advance(state, even), odd)

    first = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(BETA_TERMS)), lambda m: m.cast("double")), start, term)["h"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for a, b > 0 and x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    # The fraction converges fast below the mean; beyond it the other tail is taken.
    below = front * _beta_fraction(a, b, x) / a
    above = 1 - front * _beta_fraction(b, a, 1 - x) / b
    inside = F.when(x < (a + 1) / (a + b + 2), below).otherwise(above)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs against none: Student's t with n - 2 degrees of freedom.

    NULL below three pairs or without a correlation; 0 for a perfect one.
    """
    freedom = (n - 2).cast("double")
    # P(|T| > t) at t*t = r*r * freedom / (1 - r*r), for which freedom / (freedom + t*t) is 1 - r*r.
    tail = incomplete_beta(freedom / 2, F.lit(0.5), F.greatest(1 - r * r, F.lit(0.0)))
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), tail)


def correlation_tests(df: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """(by..., n, pearson, spearman, p_value): the rank correlation with its p-value; NULL pairs take no part."""
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    ranked = average_rank(average_rank(pairs, left, by, "_rl"), right, by, "_rr")
    found = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(left, right).alias("pearson"), F.corr("_rl", "_rr").alias("spearman")
    )
    return found.withColumn("p_value", correlation_p(F.col("spearman"), F.col("n")))


def strongest_pair(table: DataFrame, value: str = "pearson") -> DataFrame:
    """The row with the largest absolute value; ties by the other columns."""
    rest = [c for c in table.columns if c != value]
    best = F.min(F.struct((-F.abs(value)).alias("_o"), *rest, value))
    return table.agg(best.alias("_b")).select(*[F.col("_b")[c].alias(c) for c in table.columns])


def quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles, one row per group, column and level.

    The percentile aggregate holds all distinct values of a group in one task.
    Here the value counts are laid out by value over many tasks, and the two
    values around each position are picked from their running counts.
    """
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("_v")) for c in columns])
    counts = (
        df.select(*by, F.inline(pairs))
        .filter(F.col("_v").isNotNull())
        .groupBy(*by, "field", "_v")
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    goals = F.explode(F.array(*[F.lit(float(q)) for q in levels]))
    placed = (
        Ordered(counts, ["_v"], [*by, "field"])
        .scan(_upto=Scan("sum", "_m"), _n=Scan("sum", "_m", whole=True))
        .frame()
        .select("*", goals.alias("level"))
        .withColumn("_at", F.col("level") * (F.col("_n") - 1))
    )
    first, last = F.col("_upto") - F.col("_m"), F.col("_upto") - 1

    def value_at(position: Column) -> Column:
        return F.max(F.when((position >= first) & (position <= last), F.col("_v")))

    found = placed.groupBy(*by, "field", "level").agg(
        value_at(F.floor("_at")).alias("_lo"), value_at(F.ceil("_at")).alias("_hi"), F.max("_at").alias("_at")
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))
    return found.select(*by, "field", "level", value.alias("value"))


def seed_summary(
    metrics: DataFrame, model: str, seed: str, names: Sequence[str], deployed_seed: int
) -> DataFrame:
    """Mean, sample and population deviation over seeds, and the deployed seed's value."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("seed_count")]
    for m in names:
        aggregates += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_samp(m).alias(f"{m}_sd"),
            F.stddev_pop(m).alias(f"{m}_sd_population"),
            F.max(F.when(F.col(seed) == deployed_seed, F.col(m))).alias(f"{m}_deployed"),
        ]
    return metrics.groupBy(model).agg(*aggregates)


def best_of_grid(
    grid: DataFrame, by: Sequence[str], descending: Sequence[str], ascending: Sequence[str] = ()
) -> DataFrame:
    """The best row per group under ordered tie-breaks; a NULL loses to every value."""
    values = [-F.col(c) for c in descending] + [F.col(c) for c in ascending]
    order = [c for i, v in enumerate(values) for c in (v.isNull().alias(f"_n{i}"), v.alias(f"_v{i}"))]
    rest = [c for c in grid.columns if c not in by]
    best = F.min(F.struct(F.struct(*order).alias("_k"), F.struct(*rest).alias("_r")))
    picked = grid.groupBy(*by).agg(best.alias("_b")) if by else grid.agg(best.alias("_b"))
    return picked.select(*by, *[F.col("_b._r")[c].alias(c) for c in rest]).select(*grid.columns)


def metric_deltas(metrics: DataFrame, key: str, before: str, after: str, names: Sequence[str]) -> DataFrame:
    """after - before, one row per metric."""
    pick = lambda which, m: F.max(F.when(F.col(key) == which, F.col(m)))
    wide = metrics.agg(*[(pick(after, m) - pick(before, m)).alias(m) for m in names])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("delta")) for m in names])
    return wide.select(F.inline(rows))
