"""Bins, classes, hash scores, and probability transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelab.functions.sequences import _c

PROBABILITY_CLIP = 1e-7
LOGIT_CLIP = 50.0


def depth_bin(depth: str | Column, top: int = 12) -> Column:
    """floor(log2(depth)), at least 0 and at most ``top``."""
    return F.least(F.floor(F.log2(F.greatest(F.lit(1.0), _c(depth).cast("double")))), F.lit(top)).cast("bigint")


def coverage_bin(depth: str | Column) -> Column:
    return depth_bin(depth, top=15)


def gc_bin(fraction: str | Column) -> Column:
    return F.least(F.floor(_c(fraction) * 10), F.lit(9)).cast("bigint")


def efficiency_bin(effect: str | Column) -> Column:
    return F.least(F.floor(_c(effect) / 0.1), F.lit(5)).cast("bigint")


def region_class(region: str | Column) -> Column:
    text = F.lower(_c(region))
    coding = text.contains("coding") | text.contains("missense") | text.contains("synonymous")
    return (
        F.when(coding, "coding_like")
        .when(text.contains("utr"), "UTR")
        .when(text.contains("intron"), "intron_like")
        .otherwise("other_exonic")
    )


def chrom_class(chrom: str | Column) -> Column:
    numbered = F.regexp_like(_c(chrom), F.lit("^chr([1-9]|1[0-9]|2[0-2])$"))
    return F.when(numbered, "autosome").otherwise("sex_or_mito")


def id_list(text: str | Column) -> Column:
    """Sorted distinct ids of a comma-joined string, without '', NA and '-'."""
    parts = F.filter(F.split(_c(text), ","), lambda x: ~x.isin("", "NA", "-"))
    return F.array_sort(F.array_distinct(parts))


def hash_fraction(digest: Column) -> Column:
    """First 64 bits of a hex digest as a number in [0, 1)."""
    bits = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return bits / F.lit(float(2**64))


def hash_uniform(key: str | Column, seed: int | str) -> Column:
    return hash_fraction(F.sha2(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string")), 256))


def logit(p: str | Column) -> Column:
    q = F.least(F.greatest(_c(p), F.lit(PROBABILITY_CLIP)), F.lit(1 - PROBABILITY_CLIP))
    return F.ln(q / (1 - q))


def sigmoid(x: str | Column) -> Column:
    z = F.least(F.greatest(_c(x), F.lit(-LOGIT_CLIP)), F.lit(LOGIT_CLIP))
    return 1 / (1 + F.exp(-z))


def z_sigmoid(x: str | Column, mean: Column, sd: Column) -> Column:
    return sigmoid((_c(x) - mean) / F.greatest(sd, F.lit(1e-8)))


def coverage_status(depth: str | Column, alt: str | Column, minimum: int = 20) -> Column:
    return (
        F.when(_c(depth) == 0, "inadequate_zero_depth")
        .when(_c(depth) < minimum, "inadequate_low_depth")
        .when(_c(alt) == 0, "adequate_zero_alt")
        .otherwise("adequate_with_alt")
    )


def missed_positive_category(
    effect: Column, depth: Column, entropy: Column, motif_seen: Column, low_depth: Column, low_entropy: Column
) -> Column:
    """First matching reason why a positive fell below the threshold."""
    return (
        F.when(effect <= 0.15, "low_efficiency_positive")
        .when(depth <= low_depth, "coverage_related")
        .when(entropy <= low_entropy, "hard_sequence")
        .when(motif_seen, "special_motif")
        .otherwise("other")
    )


def ranked_error_category(
    label: Column,
    effect: Column,
    effect_q25: Column,
    motif_seen: Column,
    score: Column,
    cutoff: Column,
    score_scale: Column,
    outside_bounds: Column,
    rank: Column,
    audit_rank: Column,
    total: Column,
) -> Column:
    """First matching reason for an error among the ranked candidates."""
    discordant = (rank <= F.greatest(F.lit(1000), F.floor(total * 0.01))) & (audit_rank > total * 0.5)
    return (
        F.when((label == 1) & (effect <= effect_q25), "low efficiency positive")
        .when(motif_seen, "motif similar")
        .when(F.abs(score - cutoff) <= score_scale * 0.10, "boundary cases")
        .when(outside_bounds | discordant, "sequence pattern failure")
        .otherwise("other")
    )
