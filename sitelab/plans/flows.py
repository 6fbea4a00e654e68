"""The three end-to-end flows, composed from operators.

Labelling: counts -> statistics -> test and FDR -> classes and reasons.
Data sets: components -> group split -> fixed sets and pools -> assertions.
Evaluation: folds -> calibration -> choice -> thresholds -> metrics.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.functions import labels as L
from sitelab.functions import sequences as Q
from sitelab.functions.pileup import fisher_exact
from sitelab.operators import calibrate as C
from sitelab.operators import components as K
from sitelab.operators import ranking as R
from sitelab.operators import replicates as A
from sitelab.operators import splits as P
from sitelab.operators.joins import mark_positions
from sitelab.operators.skew import with_key_count
from sitelab.operators.stats import benjamini_hochberg
from sitelab.session import cut


def with_complexity(df: DataFrame, seq: str) -> DataFrame:
    measured = df.withColumns(
        {
            "_e": Q.base_entropy(seq),
            "_h": Q.longest_run(seq),
            "_d": Q.tandem_dinucleotide(seq)["coverage"],
        }
    )
    flags = Q.low_complexity(F.col("_e"), F.col("_h"), F.col("_d"))
    return measured.withColumns(flags).drop("_e", "_h", "_d")


def with_fdr(stats: DataFrame, name: str = "fdr") -> DataFrame:
    """Exact test on pooled counts where the difference is defined, then FDR."""
    stats = cut(stats)
    # The Python test sees only the rows that need it; a conditional would send all.
    defined = stats.filter(F.col("raw_difference").isNotNull())
    tested = cut(
        defined.withColumn(
            "fisher_p",
            fisher_exact("pooled_treated_alt", "pooled_treated_ref", "pooled_control_alt", "pooled_control_ref"),
        )
    )
    adjusted = benjamini_hochberg(tested, "fisher_p", name=name)
    return adjusted.unionByName(stats.filter(F.col("raw_difference").isNull()), allowMissingColumns=True)


def label_sites(
    sites: DataFrame,
    counts: DataFrame,
    samples: list[tuple],
    variants: DataFrame,
    context_pass: Column,
    key: list[str],
    seq: str = "seq",
    test: bool = True,
) -> DataFrame:
    """Site table with statistics, FDR, class flags and exclusion reasons.

    Only the high-confidence class reads the exact test; without ``test`` that class, the
    test and the FDR are left out, and only the statistics that are read are made.
    """
    groups = [g for _, g in samples]
    sizes = {g: groups.count(g) for g in set(groups)}
    stats = A.site_statistics(counts, ["site_id"], sizes)
    stats = with_fdr(stats) if test else stats
    # Placed by site first: the sequence measures are the heavy part, and the join needs that placement anyway.
    placed = sites.withColumn("context_pass", context_pass).repartition("site_id")
    joined = with_complexity(placed, seq).join(stats, "site_id")
    joined = mark_positions(joined, variants, ["chrom", "position"], "on_variant")
    joined = with_key_count(joined, key, "_copies").withColumn("unique_key", F.col("_copies") == 1)
    complex_ok = F.col("low_complexity_qc") == "PASS"
    args = (F.col("context_pass"), F.col("on_variant"), complex_ok, F.col("unique_key"))
    classes = L.positive_classes(*args, fdr=F.col("fdr") if test else None)
    if not test:
        del classes["positive_high_confidence"]
    reason = L.exclusion_reason(L.main_exclusion_rules(*args))
    negatives = {"negative_class": L.negative_class(), "near_zero": L.near_zero()}
    return joined.withColumns({**classes, **negatives, "exclusion_reason": reason}).drop("_copies")


def split_sites(sites: DataFrame, key: str = "site_key") -> DataFrame:
    """Sites with component, group size and split; components never cross splits.

    ``sites`` has key, genes, seq, chrom, position, strand, label, region, gc, efficiency.
    """
    groups = cut(K.leakage_components(sites, key))
    labelled = sites.join(groups.select(key, "component"), key)
    placed = P.split_groups(labelled, "component")
    return P.assign_splits(sites, groups, placed, key, "component")


def calibration_comparison(pred: DataFrame, folds: int, seed: int) -> DataFrame:
    """Out-of-fold Brier score and calibration error of every method, by model.

    ``pred`` is (model_id, id, label, score, grp). All models and folds of a method are fitted together.
    """
    dealt = P.grouped_folds(pred.select("id", "label", "grp").distinct(), "label", "grp", folds, seed)
    rows = cut(pred.join(dealt.select("id", "fold"), "id"))
    parts = [
        C.out_of_fold(rows, method, folds, by=["model_id"]).select(
            "model_id", F.lit(method).alias("method"), "label", F.col("probability").alias("score")
        )
        for method in C.METHODS
    ]
    oof = cut(functools.reduce(lambda a, b: a.unionByName(b), parts))
    by = ["model_id", "method"]
    brier = R.confusion(oof, F.lit(0.5), by).select(*by, "brier")
    return brier.join(R.calibration_error(oof, by), by).select(*by, "brier", "ece")
