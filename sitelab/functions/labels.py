"""Positive and negative classes, exclusion reasons and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the class definitions.
MIN_EFFECT = 0.10
MAX_CONTROL = 0.02
MAX_FDR = 0.05
MAX_TREATED_MAD = 0.05
MAX_CONTROL_MAD = 0.02
NEAR_ZERO_RATE = 0.005
MIN_REPLICATES = 2


def _covered(minimum: int) -> Column:
    return (F.col("treated_covered") >= minimum) & (F.col("control_covered") >= minimum)


def positive_classes(
    context_pass: Column,
    on_variant: Column,
    complexity_pass: Column,
    unique_key: Column,
    fdr: Column | None = None,
    minimum: int = MIN_REPLICATES,
) -> dict[str, Column]:
    """Sensitivity, main, high-confidence, and main without the complexity rule.

    The effect bound is strict, the control bound is not; the false discovery
    rate bound is strict and a missing rate never passes.
    """
    yes = F.lit(True)
    no = F.lit(False)
    base = (
        F.coalesce(F.col("corrected") > MIN_EFFECT, no)
        & _covered(minimum)
        & context_pass
        & ~on_variant
        & unique_key
    )
    quiet = F.coalesce(F.col("control_median") <= MAX_CONTROL, no)
    main = base & complexity_pass & quiet
    steady = F.coalesce(
        (F.col("treated_mad") <= MAX_TREATED_MAD) & (F.col("control_mad") <= MAX_CONTROL_MAD), no
    )
    significant = F.coalesce(fdr < MAX_FDR, no) if fdr is not None else yes
    return {
        "positive_sensitivity": base & complexity_pass,
        "positive_main": main,
        "positive_high_confidence": main & F.col("all_covered") & significant & steady,
        "positive_main_any_complexity": base & quiet,
    }


def negative_class() -> Column:
    """strict, or else relaxed, or else none."""
    strict = F.col("all_covered") & F.col("all_alt_zero")
    relaxed = _covered(MIN_REPLICATES) & F.col("covered_alt_zero")
    return F.when(strict, "strict").when(relaxed, "relaxed").otherwise("none")


def near_zero() -> Column:
    """Covered everywhere, all rates tiny, no excess in treated; not strict."""
    strict = F.col("all_covered") & F.col("all_alt_zero")
    low = F.col("max_rate") <= NEAR_ZERO_RATE
    flat = F.coalesce(F.col("raw_difference") <= 0, F.lit(False))
    return F.col("all_covered") & low & flat & ~strict


def exclusion_reason(rules: list[tuple[Column, str]]) -> Column:
    """Names of all failed rules joined by ';', or 'none'."""
    names = F.concat_ws(";", *[F.when(failed, name) for failed, name in rules])
    return F.when(names == "", "none").otherwise(names)


def main_exclusion_rules(
    context_pass: Column, on_variant: Column, complexity_pass: Column, unique_key: Column
) -> list[tuple[Column, str]]:
    missing = F.lit(True)
    return [
        (F.coalesce(F.col("corrected") <= MIN_EFFECT, missing), "corrected_efficiency_not_gt_0.10"),
        (F.col("treated_covered") < MIN_REPLICATES, "treated_coverage_lt_2of3"),
        (F.col("control_covered") < MIN_REPLICATES, "control_coverage_lt_2of3"),
        (F.coalesce(F.col("control_median") > MAX_CONTROL, missing), "control_median_gt_0.02"),
        (~context_pass, "orientation_or_context_qc"),
        (on_variant, "WGS_center_overlap"),
        (~complexity_pass, "obvious_low_complexity"),
        (~unique_key, "duplicate_genomic_key"),
    ]


def label_confidence(eligible: Column) -> Column:
    steady = F.coalesce(
        (F.col("treated_mad") <= MAX_TREATED_MAD) & (F.col("control_mad") <= MAX_CONTROL_MAD), F.lit(False)
    )
    return (
        F.when(eligible & F.col("all_covered") & steady, "high").when(eligible, "moderate").otherwise("low")
    )
