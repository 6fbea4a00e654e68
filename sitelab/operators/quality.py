"""Data-quality assertions as tables of (assertion, status, violations)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.functions.records import known_genes
from sitelab.operators.intervals import neighbour_pairs


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count the rows that break each rule, in one pass. A rule is true for a bad row."""
    names = list(checks)
    counted = df.agg(*[F.count_if(F.coalesce(checks[n], F.lit(False))).alias(f"v{i}") for i, n in enumerate(names)])
    rows = F.array(
        *[F.struct(F.lit(n).alias("assertion"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(names)]
    )
    return with_status(counted.select(F.inline(rows)))


def with_status(df: DataFrame) -> DataFrame:
    return df.select(
        "assertion",
        F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.col("violations").cast("bigint").alias("violations"),
    )


def crossing_keys(df: DataFrame, name: str, key: Column, split: str = "split") -> DataFrame:
    """Keys seen in more than one split; the smallest and largest split suffice to tell."""
    ends = df.select(key.alias("_key"), split).groupBy("_key").agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return ends.agg(F.count_if(F.col("a") != F.col("b")).alias("violations")).select(
        F.lit(name).alias("assertion"), "violations"
    )


def leakage_suite(
    sites: DataFrame,
    key: str = "site_key",
    genes: str = "genes",
    sequence: str = "seq",
    group: str = "component",
    distance: int = 100,
) -> DataFrame:
    """Genes, sequences, keys, centres, groups and windows must not cross splits; missing genes are no gene."""
    exploded = sites.select("split", F.explode(known_genes(genes)).alias("gene"))
    parts = [
        crossing_keys(exploded, "gene_id_not_cross_split", F.col("gene")),
        crossing_keys(sites, "exact_sequence_not_cross_split", F.sha2(sequence, 256)),
        crossing_keys(sites, "genomic_key_not_cross_split", F.col(key)),
        crossing_keys(
            sites, "genomic_center_not_cross_split", F.concat_ws(":", "chrom", F.col("position").cast("string"))
        ),
        crossing_keys(sites, "leakage_group_not_cross_split", F.col(group)),
    ]
    at = sites.groupBy("chrom", "strand", "position").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    pairs = neighbour_pairs(sites, ["chrom", "strand"], "position", distance)
    before = at.select("chrom", "strand", F.col("position").alias("previous"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    crossing = (
        pairs.join(at, ["chrom", "strand", "position"])
        .join(before, ["chrom", "strand", "previous"])
        .filter((F.least("a", "pa") != F.greatest("b", "pb")))
    )
    parts.append(
        crossing.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit("overlapping_windows_not_cross_split").alias("assertion"), "violations"
        )
    )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return with_status(table)


def strict_negatives(negatives: DataFrame, counts: DataFrame, site: str, samples: int, depth: int = 20) -> DataFrame:
    """A negative needs every sample with enough depth and without the alternative base; one without counts fails too."""
    fit = (F.col("depth") >= depth) & (F.col("alt") == 0)
    good = counts.groupBy(site).agg(F.count_distinct(F.when(fit, F.col("sample"))).alias("_good"), F.count_if(~fit).alias("_bad"))
    rows = negatives.select(site).join(good, site, "left")
    bad = (F.coalesce("_good", F.lit(0)) < samples) | (F.coalesce("_bad", F.lit(0)) > 0)
    return violations(rows, {"strict_all_samples_covered_and_alt_zero": bad})


def context_rules(sequence: str = "seq", length: int = 101, centre: str = "C") -> dict[str, Column]:
    """Length and centre base of every context; a missing one breaks the rule."""
    right = (F.length(sequence) == length) & (F.substring(sequence, length // 2 + 1, 1) == centre)
    return {"sequence_context_length_and_centre": ~F.coalesce(right, F.lit(False))}


def exact_ratio(rows: DataFrame, name: str, ratio: int) -> DataFrame:
    """``ratio`` negatives per positive to the row, and a positive at least; the violations are the rows off."""
    p, q = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    off = F.when(p == 0, F.greatest(q, F.lit(1))).otherwise(F.abs(p * ratio - q))
    return with_status(rows.agg(off.alias("violations")).select(F.lit(name).alias("assertion"), "violations"))


def never_mined(mined: DataFrame, split: str = "test") -> DataFrame:
    """Rows of a split that hard-negative mining has used."""
    return violations(mined, {f"{split}_not_used_for_hard_negative_mining": F.col("split") == split})


def publication_suite(
    sites: DataFrame, negatives: DataFrame, counts: DataFrame, sets: dict[str, DataFrame], mined: DataFrame, samples: int, ratio: int, **columns: str
) -> DataFrame:
    """All assertions that stand before a release: leakage, the strict rule, contexts, exact sets, mining.

    ``columns`` names the columns of ``sites`` as for ``leakage_suite``; negatives and counts share its key.
    """
    key = columns.get("key", "site_key")
    parts = [
        leakage_suite(sites, **columns),
        strict_negatives(negatives, counts, key, samples),
        violations(sites, context_rules(columns.get("sequence", "seq"))),
        *[exact_ratio(rows, f"{name}_exact_1to{ratio}", ratio) for name, rows in sets.items()],
        never_mined(mined),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def count_rules(minimum: int = 20) -> dict[str, Column]:
    """Invariants of a long count row."""
    return {
        "depth_is_sum_of_counts": F.col("depth") != F.col("ref") + F.col("alt") + F.col("other"),
        "counts_not_negative": F.least("depth", "ref", "alt", "other") < 0,
        "rate_within_unit": (F.col("depth") > 0) & (F.col("alt") > F.col("depth")),
    }


def completeness(counts: DataFrame, site: str, samples: int) -> DataFrame:
    """Each site must have each sample exactly once."""
    per_site = counts.groupBy(site, "sample").agg(F.count(F.lit(1)).alias("_c")).groupBy(site).agg(
        F.count(F.lit(1)).alias("present"), F.max("_c").alias("copies")
    )
    return violations(
        per_site,
        {
            "all_samples_present": F.col("present") != samples,
            "no_repeated_sample": F.col("copies") > 1,
        },
    )


def label_rules(minimum: int = 2) -> dict[str, Column]:
    """Invariants of a labelled site; a missing group must never count as zero."""
    short_t, short_c = F.col("treated_covered") < minimum, F.col("control_covered") < minimum
    has = F.col("raw_difference").isNotNull() | F.col("corrected").isNotNull() | F.col("eligible")
    reason = F.col("exclusion_reason")
    return {
        "corrected_not_negative": F.col("corrected") < 0,
        "missing_difference_has_no_effect": F.col("raw_difference").isNull() & F.col("corrected").isNotNull(),
        "short_control_is_missing": short_c & (has | ~reason.contains("low_control_coverage")),
        "short_treated_is_missing": short_t & (has | ~reason.contains("low_treated_coverage")),
    }


def parity(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full-outer comparison of two count tables; a missing side counts as zero."""
    left = a.select(*key, *[F.col(v).alias(f"_a_{v}") for v in values])
    right = b.select(*key, *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = left.join(right, list(key), "full")
    same = F.lit(True)
    for v in values:
        same = same & (F.coalesce(f"_a_{v}", F.lit(0)) == F.coalesce(f"_b_{v}", F.lit(0)))
    return joined.select(
        *key,
        *[F.coalesce(f"_a_{v}", F.lit(0)).alias(f"generated_{v}") for v in values],
        *[F.coalesce(f"_b_{v}", F.lit(0)).alias(f"direct_{v}") for v in values],
        same.alias("validation_pass"),
    )


def same_keys(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys missing on either side."""
    sides = expected.select(*key).distinct().withColumn("_s", F.lit(1)).unionByName(
        observed.select(*key).distinct().withColumn("_s", F.lit(2))
    )
    return (
        sides.groupBy(*key)
        .agg(F.sum("_s").alias("_s"))
        .agg(
            F.count_if(F.col("_s") == 1).alias("only_expected"),
            F.count_if(F.col("_s") == 2).alias("only_observed"),
            F.count_if(F.col("_s") == 3).alias("in_both"),
        )
    )


def model_agreement(pred: DataFrame, models: int, key: str = "id") -> DataFrame:
    """Ids must occur once per model with one label."""
    per_id = pred.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"), F.count("score").alias("s")
    )
    return violations(
        per_id,
        {
            "every_model_scores_every_id_once": F.col("n") != models,
            "labels_agree": F.col("a") != F.col("b"),
            "no_missing_score": F.col("s") != F.col("n"),
        },
    )


def selection_digest(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Order-free digest of a selection of unique ids: count and xor of 64-bit hashes."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.col(key).cast("string"))).alias("digest")
    )


def expected_values(metrics: DataFrame, expected: DataFrame, key: Sequence[str], tolerance: float) -> DataFrame:
    """Full-outer check of (key..., value) against expected values within a tolerance."""
    joined = metrics.select(*key, F.col("value").alias("_got")).join(
        expected.select(*key, F.col("value").alias("_want")), list(key), "full"
    )
    off = F.col("_got").isNull() | F.col("_want").isNull() | (F.abs(F.col("_got") - F.col("_want")) > tolerance)
    return joined.select(*key, F.when(off, "FAIL").otherwise("PASS").alias("status"))


def dictionary_match(expected: DataFrame, observed: DataFrame, name: str, length: str) -> DataFrame:
    """Names missing on either side, or with different lengths (contigs, sample sheets)."""
    joined = expected.select(name, F.col(length).alias("_e")).join(
        observed.select(name, F.col(length).alias("_o")), name, "full"
    )
    state = (
        F.when(F.col("_o").isNull(), "missing_observed")
        .when(F.col("_e").isNull(), "unexpected")
        .when(F.col("_e") != F.col("_o"), "length_differs")
        .otherwise("match")
    )
    return joined.select(name, state.alias("state"))
