"""Ranking and classification metrics for many models in one pass.

Input is long: (model_id, id, label, score). All curves come from one table with
a row per model and distinct score; its running sums are computed over ranges of
scores, so one model may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.operators.ordering import Ordered, Scan, global_rank
from sitelab.operators.skew import first_by
from sitelab.operators.stats import quantiles

# Validation budgets and bins of the calibration error.
BUDGETS = (10, 50, 100, 500, 1000)
ECE_BINS = 15


def unpivot_scores(wide: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per id and model."""
    return wide.unpivot(list(ids), list(models), "model_id", "score")


def rank_scores(pred: DataFrame, by: Sequence[str] = ("model_id",), key: str = "id") -> DataFrame:
    """Rank 1.. by score descending, then id."""
    return global_rank(pred, ["-score", key], by=list(by), name="rank")


def score_table(pred: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """One row per distinct score with running counts from the highest score down.

    tp, fp: positives and negatives at or above the score; positives, negatives:
    totals of the group.
    """
    by = list(by)
    steps = pred.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return (
        Ordered(steps, ["-score"], by)
        .scan(
            tp=Scan("sum", "pos"),
            fp=Scan("sum", "neg"),
            positives=Scan("sum", "pos", whole=True),
            negatives=Scan("sum", "neg", whole=True),
        )
        .frame()
    )


def curve_points(table: DataFrame) -> DataFrame:
    """Precision, recall and false positive rate at every distinct score."""
    return table.withColumns(
        {
            "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
            "recall": F.try_divide("tp", "positives"),
            "fpr": F.try_divide("fp", "negatives"),
        }
    )


def area_metrics(table: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Average precision, trapezoid PR area and ROC area (ties count half); NULL without both classes."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    before_tp, before_fp = tp - pos, fp - neg
    precision = tp / (tp + fp)
    # The curve starts at recall 0 with precision 1.
    earlier = F.when(before_tp + before_fp > 0, before_tp / (before_tp + before_fp)).otherwise(F.lit(1.0))
    gain = F.try_divide(pos, F.col("positives"))
    return table.groupBy(*by).agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.sum(gain * precision).alias("average_precision"),
        F.sum(gain * (precision + earlier) / 2).alias("pr_auc"),
        F.try_divide(
            F.sum(pos * (F.col("negatives") - fp + neg / 2)), F.max("positives") * F.max("negatives")
        ).alias("roc_auc"),
    )


def ndcg(ranked: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Linear gain, log2 discount; rows of equal score share their mean discount."""
    by = list(by)
    discount = 1 / F.log2(F.col("rank") + 1)
    ties = ranked.groupBy(*by, "score").agg(
        F.avg(discount).alias("share"), F.sum("label").alias("gain")
    )
    actual = ties.groupBy(*by).agg(F.sum(F.col("share") * F.col("gain")).alias("dcg"), F.sum("gain").alias("p"))
    # The ideal ranking has its positives on ranks 1..p.
    ideal = (
        ranked.select(*by, "rank")
        .join(actual.select(*by, "p"), by)
        .filter(F.col("rank") <= F.col("p"))
        .groupBy(*by)
        .agg(F.sum(discount).alias("best"))
    )
    return actual.join(ideal, by).select(*by, (F.col("dcg") / F.col("best")).alias("ndcg"))


def budget_table(
    ranked: DataFrame, by: Sequence[str] = ("model_id",), budgets: Sequence[int] = BUDGETS
) -> DataFrame:
    """Discoveries, precision, recall and enrichment at each budget; a budget is capped at the row count."""
    by = list(by)
    rank, label = F.col("rank"), F.col("label")
    found = [F.sum(F.when(rank <= k, label).otherwise(F.lit(0))).alias(f"d{k}") for k in budgets]
    totals = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"), *found)
    rows = F.array(
        *[
            F.struct(F.lit(k).cast("bigint").alias("budget"), F.col(f"d{k}").cast("bigint").alias("discovered"))
            for k in budgets
        ]
    )
    used = F.least("budget", "n")
    background = F.col("p") / F.col("n")
    return totals.select(*by, "n", "p", F.inline(rows)).select(
        *by,
        "budget",
        "discovered",
        (F.col("discovered") / used).alias("precision"),
        (F.col("discovered") / F.col("p")).alias("recall"),
        (F.col("discovered") / used / background).alias("enrichment"),
        background.alias("background_rate"),
    )


def ranking_metrics(
    pred: DataFrame, by: Sequence[str] = ("model_id",), key: str = "id", budgets: Sequence[int] = BUDGETS
) -> DataFrame:
    """One row per model with all ranking metrics and the selection score."""
    by = list(by)
    ranked = rank_scores(pred, by, key)
    areas = area_metrics(score_table(pred, by), by)
    wide = (
        budget_table(ranked, by, budgets)
        .groupBy(*by)
        .agg(
            *[
                F.max(F.when(F.col("budget") == k, F.col(m))).alias(f"{m}_at_{k}")
                for k in budgets
                for m in ("discovered", "precision", "recall", "enrichment")
            ],
            F.avg("precision").alias("selection_mean_precision_at_k"),
        )
    )
    return areas.join(ndcg(ranked, by), by).join(wide, by)


SELECTION_ORDER = (
    "selection_mean_precision_at_k",
    "precision_at_100",
    "precision_at_500",
    "average_precision",
)


def confusion(pred: DataFrame, threshold: Column, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Confusion counts and derived rates at a threshold on the score; 0 where undefined."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    counts = pred.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": ratio(tp * tn - fp * fn, root),
            "fp_per_million": fp / F.greatest(F.lit(1.0), fp + tn) * 1_000_000,
        }
    )


def calibration_error(
    pred: DataFrame, by: Sequence[str] = ("model_id",), bins: int = ECE_BINS
) -> DataFrame:
    """Expected calibration error over equal-width bins; the last bin is closed."""
    cell = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    inside = (F.col("score") >= 0) & (F.col("score") <= 1)
    cells = pred.groupBy(*by, F.when(inside, cell).alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"), F.sum("score").alias("s")
    )
    miss = F.when(F.col("_cell").isNotNull(), F.abs(F.col("y") - F.col("s"))).otherwise(F.lit(0.0))
    return cells.groupBy(*by).agg((F.sum(miss) / F.sum("n")).alias("ece"))


def reliability_points(pred: DataFrame, by: Sequence[str] = ("model_id",), bins: int = 12) -> DataFrame:
    """Mean score and observed rate in quantile bins; equal scores never part."""
    by = list(by)
    points = quantiles(pred, by, ["score"], [i / bins for i in range(1, bins)])
    edges = points.groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("_edges"))
    # A score equal to an edge belongs to the bin below it.
    cell = F.size(F.filter("_edges", lambda e: e < F.col("score")))
    return (
        pred.join(edges, by)
        .groupBy(*by, cell.cast("bigint").alias("bin"))
        .agg(
            F.avg("score").alias("mean_score"), F.avg("label").alias("observed_rate"), F.count(F.lit(1)).alias("n")
        )
    )


def fp_budget_threshold(pred: DataFrame, targets: Sequence[int], by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Per FP-per-million target: the negative score that has to be exceeded.

    ``allowed`` false positives are permitted; a row is positive when its score
    is above the (allowed+1)-th negative, or always when there are fewer.
    """
    by = list(by)
    table = score_table(pred, by)
    goals = F.explode(F.array(*[F.lit(t).cast("bigint") for t in targets]))
    steps = table.select("*", goals.alias("target_fp_per_million")).withColumn(
        "allowed_fp", F.floor(F.col("target_fp_per_million") * F.col("negatives") / 1_000_000)
    )
    # Rows strictly above the limit: the tied scores that still leave fp <= allowed.
    keep = F.col("fp") <= F.col("allowed_fp")
    grouped = steps.groupBy(*by, "target_fp_per_million").agg(
        F.max("allowed_fp").alias("allowed_fp"),
        F.max(F.when(~keep, F.col("score"))).alias("exceed_score"),
        F.coalesce(F.max(F.when(keep, F.col("tp"))), F.lit(0)).alias("tp"),
        F.coalesce(F.max(F.when(keep, F.col("fp"))), F.lit(0)).alias("fp"),
        F.max("positives").alias("_p"),
        F.max("negatives").alias("_n"),
    )
    return with_rates(
        grouped.withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("fp")).drop("_p", "_n")
    )


def budget_cutoffs(
    ranked: DataFrame, by: Sequence[str] = ("model_id",), budgets: Sequence[int] = BUDGETS
) -> DataFrame:
    """Score at rank K (K capped at the row count) and how many rows reach it."""
    by = list(by)
    sizes = ranked.groupBy(*by).agg(F.max("rank").alias("_n"))
    goals = sizes.select(
        *by, F.explode(F.array(*[F.lit(k).cast("bigint") for k in budgets])).alias("budget"), "_n"
    ).withColumn("rank", F.least("budget", "_n"))
    cut = ranked.join(goals, [*by, "rank"]).select(*by, "budget", F.col("score").alias("cutoff"))
    reach = (
        ranked.select(*by, "score")
        .join(cut, by)
        .groupBy(*by, "budget", "cutoff")
        .agg(F.count_if(F.col("score") >= F.col("cutoff")).alias("at_or_above"))
    )
    return reach


def threshold_strategies(ranked: DataFrame, cutoffs: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Exact top-K, frozen score threshold, and threshold with a cap at K."""
    by = list(by)
    rank, label = F.col("rank"), F.col("label")
    above = F.col("score") >= F.col("cutoff")
    capped = above & (rank <= F.col("budget"))
    counts = (
        ranked.join(cutoffs.select(*by, "budget", "cutoff"), by)
        .groupBy(*by, "budget", "cutoff")
        .agg(
            F.sum(F.when(rank <= F.col("budget"), label).otherwise(0)).alias("top_found"),
            F.count_if(above).alias("above"),
            F.sum(F.when(above, label).otherwise(0)).alias("above_found"),
            F.count_if(capped).alias("capped"),
            F.sum(F.when(capped, label).otherwise(0)).alias("capped_found"),
        )
    )

    def row(name: str, selected: str, found: str, threshold: Column):
        return F.struct(
            F.lit(name).alias("strategy"),
            F.col(selected).cast("bigint").alias("selected"),
            F.col(found).cast("bigint").alias("discovered"),
            threshold.cast("double").alias("threshold"),
        )

    rows = F.array(
        row("Top-K only", "budget", "top_found", F.lit(None)),
        row("score threshold", "above", "above_found", F.col("cutoff")),
        row("threshold + Top-K", "capped", "capped_found", F.col("cutoff")),
    )
    return counts.select(*by, "budget", F.inline(rows))


def best_per_sequence(df: DataFrame, sequence_hash: str, score: str, key: str) -> DataFrame:
    """The best row per sequence; partial aggregation, no sort within a popular sequence."""
    return first_by(df, [sequence_hash], [-F.col(score), F.col(key)])


def subgroup_rows(pred: DataFrame, fields: dict[str, Column], minimum: int) -> DataFrame:
    """Rows repeated per grouping field as (field, grp), small groups dropped."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("field"), v.cast("string").alias("grp")) for n, v in fields.items()]
    )
    long = pred.select("id", "label", "score", F.inline(pairs))
    sizes = long.groupBy("field", "grp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return long.join(sizes, ["field", "grp"]).drop("_n")


def tertile(value: str | Column, low: Column, high: Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v <= low, "low").when(v <= high, "medium").otherwise("high")
