"""Platt and isotonic calibration, out-of-fold scores, and frozen parameters."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelab.functions.scoring import PROBABILITY_CLIP, logit, sigmoid
from sitelab.operators.ordering import Ordered, Scan, global_rank
from sitelab.session import cut

METHODS = ("none", "platt", "isotonic")
ROWS_PER_TASK = 25_000


def logistic(
    df: DataFrame,
    features: str,
    label: str,
    c: float = 1.0,
    intercept: bool = True,
    weight: str | None = None,
    max_iter: int = 200,
    tol: float = 1e-6,
):
    """L2 logistic regression with the usual inverse-strength parameter C.

    The rows are cached once in parallel. A small training set then runs in few
    tasks, because each of the many short iterations pays for every task.
    """
    used = [features, label] + ([weight] if weight is not None else [])
    data = df.select(*used).persist()
    try:
        rows = data.count()
        strength = rows if weight is None else data.agg(F.sum(weight)).first()[0]
        model = LogisticRegression(
            featuresCol=features,
            labelCol=label,
            regParam=1.0 / (c * strength),
            elasticNetParam=0.0,
            standardization=False,
            fitIntercept=intercept,
            maxIter=max_iter,
            tol=tol,
        )
        if weight is not None:
            model = model.setWeightCol(weight)
        return model.fit(data.coalesce(1 + rows // ROWS_PER_TASK))
    finally:
        data.unpersist()


#: One fit over all rows is a fit of one group, which this column names.
ALL = "_fit"
#: Ordered rows of a fit that one task pools at a time.
RANGE = 50_000
NEWTON_STEPS = 60


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows with the columns that name their fit; NULL is a fit like any other."""
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def _of_fit(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the values that ``table`` holds for their fit."""
    values = [c for c in table.columns if c not in by]
    named = table.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *values)
    same = functools.reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)])
    return rows.join(named, same).drop(*[f"_k{i}" for i in range(len(by))])


def clipped(score: str | Column) -> Column:
    """A probability away from 0 and 1."""
    score = F.col(score) if isinstance(score, str) else score
    return F.least(F.greatest(score, F.lit(PROBABILITY_CLIP)), F.lit(1 - PROBABILITY_CLIP))


@dataclass(frozen=True)
class Platt:
    """Sigmoids of slope * x + intercept, with x the logit of a probability or the raw score.

    ``fits`` is a table (by..., slope, intercept), one row per fit.
    """

    fits: DataFrame
    by: tuple[str, ...] = ()
    on_logit: bool = True

    def apply(self, df: DataFrame, score: str, name: str) -> DataFrame:
        rows, by = _grouped(df, self.by)
        x = logit(score) if self.on_logit else F.col(score)
        fitted = _of_fit(rows, self.fits.withColumnsRenamed({"slope": "_slope", "intercept": "_intercept"}), by)
        return fitted.withColumn(name, sigmoid(x * F.col("_slope") + F.col("_intercept"))).select(*_with(df.columns, name))


def _with(columns: list[str], name: str) -> list[str]:
    return [*[c for c in columns if c != name], name]


def _newton_step(a: float, b: float, r, c: float) -> tuple[float, float]:
    """One penalised Newton step; a flat direction is left alone."""
    g1, g2, h11, h12, h22 = r["g1"] - a / c, r["g2"], r["h11"] + 1 / c, r["h12"], r["h22"]
    det = h11 * h22 - h12 * h12
    if det <= 1e-12 * h11 * max(h22, 1e-300):
        return g1 / h11, 0.0
    return (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det


def fit_platt(
    df: DataFrame, score: str = "score", label: str = "label", on_logit: bool = True, by: Sequence[str] = (), c: float = 1e6, tol: float = 1e-10
) -> Platt:
    """Sigmoid fits of all groups of ``by`` together.

    Each Newton step is one aggregation of gradient, curvature and loss over all fits that
    are still moving, after equal scores have been pooled; five numbers per fit reach the
    driver, never rows. A step that makes the loss larger is halved.
    """
    rows, by = _grouped(df, by)
    x = logit(score) if on_logit else F.col(score)
    data = cut(
        rows.groupBy(*by, x.cast("double").alias("_x")).agg(F.sum(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).alias("_w"))
    )
    spark, keys = df.sparkSession, [data.schema[b] for b in by]
    kind = T.StructType([*keys, T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())])
    z = F.col("_a") * F.col("_x") + F.col("_b")
    p = sigmoid(z)
    bend = F.col("_w") * p * (1 - p)
    # log(1 + exp(z)) without overflow.
    loss = F.col("_w") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("_y") * z
    sums = {
        "g1": (F.col("_y") - F.col("_w") * p) * F.col("_x"), "g2": F.col("_y") - F.col("_w") * p,
        "h11": bend * F.col("_x") * F.col("_x"), "h12": bend * F.col("_x"), "h22": bend, "loss": loss,
    }
    where = {tuple(r): (0.0, 0.0) for r in data.select(*by).distinct().collect()}
    done, last = {}, {}
    for _ in range(NEWTON_STEPS):
        if not where:
            break
        at = spark.createDataFrame([(*k, *v) for k, v in where.items()], kind)
        moved = {}
        for r in _of_fit(data, at, by).groupBy(*by).agg(*[F.sum(v).alias(n) for n, v in sums.items()]).collect():
            key = tuple(r[b] for b in by)
            a, b = where[key]
            total = r["loss"] + a * a / (2 * c)
            if key in last and total > last[key][2] + 1e-9 * abs(last[key][2]):
                # Halfway back to where the step came from.
                moved[key] = ((a + last[key][0]) / 2, (b + last[key][1]) / 2)
                continue
            last[key] = (a, b, total)
            da, db = _newton_step(a, b, r, c)
            if max(abs(da), abs(db)) <= tol * (1 + abs(a) + abs(b)):
                done[key] = (a + da, b + db)
            else:
                moved[key] = (a + da, b + db)
        where = moved
    # Separable classes have no finite optimum without the penalty; the last step stands.
    done.update(where)
    named = T.StructType([*keys, T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType())])
    return Platt(spark.createDataFrame([(*k, *v) for k, v in done.items()], named), () if by == [ALL] else tuple(by), on_logit)


def require_increasing(platt: Platt) -> Platt:
    if (falling := platt.fits.filter("slope <= 0").first()) is not None:
        raise ValueError(f"calibration slope is not positive: {falling.asDict()}")
    return platt


@dataclass(frozen=True)
class Isotonic:
    """Step points of monotone fits; linear between them, clipped outside.

    ``points`` is a table (by..., x, y), one row per block boundary.
    """

    points: DataFrame
    by: tuple[str, ...] = ()

    def apply(self, df: DataFrame, score: str, name: str) -> DataFrame:
        """As-of join in both directions over a range layout of scores and boundaries."""
        rows, by = _grouped(df, self.by)
        marks = rows.withColumn("_x", F.col(score)).withColumn("_px", F.lit(None).cast("double")).withColumn(
            "_py", F.lit(None).cast("double")
        )
        steps = self.points.select(*by, F.col("x").alias("_x"), F.col("x").alias("_px"), F.col("y").alias("_py"))
        both = marks.unionByName(steps, allowMissingColumns=True).withColumn("_real", F.col("_px").isNull())
        both = both.withColumn("_p", F.when(~F.col("_real"), F.struct("_px", "_py")))
        # A boundary sorts before the scores equal to it, so equal scores see it on the left.
        # _id only makes the order total.
        both = both.withColumn("_id", F.xxhash64(*[F.col(c) for c in df.columns]))
        scanned = (
            Ordered(both, ["_x", "_real", "_id"], by)
            .scan(_l=Scan("max", "_p"), _r=Scan("min", "_p", reverse=True))
            .frame()
            .filter("_real")
        )
        lx, ly, rx, ry = F.col("_l._px"), F.col("_l._py"), F.col("_r._px"), F.col("_r._py")
        between = ly + (ry - ly) * (F.col("_x") - lx) / (rx - lx)
        value = F.when(F.col("_l").isNull(), ry).when(F.col("_r").isNull() | (F.col("_x") == lx), ly).otherwise(between)
        return scanned.withColumn("_value", value).select(*[c for c in df.columns if c != name], F.col("_value").alias(name))


def _pooled(frame: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators of one range of blocks (_lo, _hi, _s, _w), the mean of a block being _s / _w."""
    frame = frame.sort_values("_lo")
    low, high, total, weight = [], [], [], []
    for lo, hi, s, w in zip(*(frame[c].tolist() for c in ("_lo", "_hi", "_s", "_w")), strict=True):
        while low and total[-1] * w >= s * weight[-1]:
            lo, s, w = low.pop(), s + total.pop(), w + weight.pop()
            high.pop()
        low.append(lo)
        high.append(hi)
        total.append(s)
        weight.append(w)
    out = frame.drop(columns="_r").head(len(low)).copy()
    out["_lo"], out["_hi"], out["_s"], out["_w"] = low, high, total, weight
    return out


def pooled_blocks(df: DataFrame, by: Sequence[str], size: int = RANGE) -> DataFrame:
    """Blocks of the monotone fit from ordered blocks (by..., _lo, _hi, _s, _w).

    Ranges of ``size`` blocks of a fit are pooled on their own. Then ranges that lie half a
    range further on are pooled, which merges across the old edges, and so on in turn.
    Pooling is exact in any order, so once two rounds in a row find nothing to merge, no two
    neighbours are left to merge, and the blocks are the fit of the whole. No task holds
    more than one range; the blocks remain a table throughout.
    """
    blocks, before, quiet, turn = df, None, 0, 0
    while quiet < 2:
        placed = global_rank(blocks, ["_lo"], by, name="_r")
        cell = F.floor((F.col("_r") - 1 + (size // 2 if turn % 2 else 0)) / size).alias("_cell")
        blocks = cut(placed.groupBy(*by, cell).applyInPandas(_pooled, df.schema))
        if turn == 0 and placed.filter(F.col("_r") > size).isEmpty():
            break  # Every fit is one range: there are no edges.
        count = blocks.count()
        quiet = quiet + 1 if count == before else 0
        before, turn = count, turn + 1
    return blocks


def fit_isotonic(
    df: DataFrame, score: str = "score", label: str = "label", clip: bool = True, by: Sequence[str] = (), size: int = RANGE
) -> Isotonic:
    """Monotone least-squares fits of all groups of ``by`` together; equal scores are pooled first."""
    rows, by = _grouped(df, by)
    x = clipped(score) if clip else F.col(score)
    single = rows.groupBy(*by, x.cast("double").alias("_lo")).agg(
        F.sum(F.col(label).cast("double")).alias("_s"), F.count(F.lit(1)).cast("double").alias("_w")
    )
    blocks = pooled_blocks(single.select(*by, "_lo", F.col("_lo").alias("_hi"), "_s", "_w"), by, size)
    ends = F.array_distinct(F.array("_lo", "_hi"))
    points = blocks.select(*by, F.explode(ends).alias("x"), (F.col("_s") / F.col("_w")).alias("y"))
    return Isotonic(points, () if by == [ALL] else tuple(by))


def apply_method(df: DataFrame, method: str, model, score: str, name: str) -> DataFrame:
    if method == "none":
        return df.withColumn(name, clipped(score))
    if method == "platt":
        return model.apply(df, score, name)
    return model.apply(df.withColumn("_clipped", clipped(score)), "_clipped", name).drop("_clipped")


def fit_method(df: DataFrame, method: str, score: str = "score", label: str = "label", by: Sequence[str] = ()):
    if method == "none":
        return None
    return fit_platt(df, score, label, by=by) if method == "platt" else fit_isotonic(df, score, label, by=by)


def out_of_fold(df: DataFrame, method: str, folds: int, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Each row gets the probability of the fit on its group's other folds; ``df`` has a fold column 0..folds-1.

    All folds of all groups are fitted at once: a row takes part in the fits of the other folds.
    """
    others = F.filter(F.array(*map(F.lit, range(folds))), lambda i: i != F.col("fold"))
    model = None
    if method != "none":
        training = df.select(*by, score, label, F.explode(others).alias("_of"))
        model = fit_method(training, method, score, label, [*by, "_of"])
    scored = apply_method(df.withColumn("_of", F.col("fold").cast("int")), method, model, score, "probability")
    return scored.drop("_of")


def choose_method(comparison: DataFrame, by: list[str]) -> DataFrame:
    """Lowest Brier score, then lowest calibration error; a NULL loses to every value."""
    order = F.struct(F.isnull("brier"), "brier", F.isnull("ece"), "ece", "method")
    return comparison.groupBy(*by).agg(F.min_by("method", order).alias("method"), F.min("brier").alias("brier"))
