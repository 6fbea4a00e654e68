"""Column functions on nucleotide strings; all JVM-side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the low-complexity rule and their printed names.
MIN_ENTROPY = 1.20
MAX_RUN = 20
MAX_TANDEM = 0.80
ENTROPY_RULE = "entropy_lt_1.20"
RUN_RULE = "homopolymer_run_ge_20"
TANDEM_RULE = "dinucleotide_tandem_coverage_ge_0.80"


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def reverse_complement(seq: str | Column) -> Column:
    return F.translate(F.reverse(F.upper(_c(seq))), "ACGT", "TGCA")


def base_count(seq: str | Column, base: str) -> Column:
    return F.length(_c(seq)) - F.length(F.replace(_c(seq), F.lit(base), F.lit("")))


def gc_fraction(seq: str | Column) -> Column:
    return (base_count(seq, "G") + base_count(seq, "C")) / F.length(_c(seq))


def base_entropy(seq: str | Column) -> Column:
    """Shannon entropy in bits of the A, C, G, T composition."""

    def term(base: str) -> Column:
        share = base_count(seq, base) / F.length(_c(seq))
        return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))

    return term("A") + term("C") + term("G") + term("T")


def longest_run(seq: str | Column) -> Column:
    runs = F.regexp_extract_all(_c(seq), F.lit(r"((.)\2*)"), F.lit(1))
    return F.array_max(F.transform(runs, F.length))


def tandem_dinucleotide(seq: str | Column) -> Column:
    """Longest run of one 2-mer at phase 0 or 1: struct(coverage, phase, motif).

    A run found by the pattern has even length, so the next match starts in the
    same phase. Ties go to the lower phase, then to the smaller motif.
    """

    def runs(phase: int) -> Column:
        found = F.regexp_extract_all(F.substring(_c(seq), 1 + phase, 1 << 30), F.lit(r"((..)\2*)"), F.lit(1))
        return F.transform(
            found,
            lambda run: F.struct(
                (-F.length(run)).alias("negative_bases"),
                F.lit(phase).alias("phase"),
                F.substring(run, 1, 2).alias("motif"),
            ),
        )

    best = F.array_min(F.concat(runs(0), runs(1)))
    return F.struct(
        (-best["negative_bases"] / F.length(_c(seq))).alias("coverage"),
        best["phase"].alias("phase"),
        best["motif"].alias("motif"),
    )


def low_complexity(entropy: Column, run: Column, coverage: Column) -> dict[str, Column]:
    """The three triggers, the joined rule names, and PASS / FAIL_LOW_COMPLEXITY."""
    by_entropy = entropy < MIN_ENTROPY
    by_run = run >= MAX_RUN
    by_tandem = coverage >= MAX_TANDEM
    names = F.concat_ws(
        ";", F.when(by_entropy, ENTROPY_RULE), F.when(by_run, RUN_RULE), F.when(by_tandem, TANDEM_RULE)
    )
    return {
        "entropy_trigger": by_entropy,
        "homopolymer_trigger": by_run,
        "dinucleotide_trigger": by_tandem,
        "triggered_rules": F.when(names == "", "none").otherwise(names),
        "low_complexity_qc": F.when(by_entropy | by_run | by_tandem, "FAIL_LOW_COMPLEXITY").otherwise("PASS"),
    }


def centre_crop(seq: str | Column, width: int) -> Column:
    """The middle ``width`` letters (odd width, odd length)."""
    start = ((F.length(_c(seq)) - width) / 2).cast("int") + 1
    return F.substring(_c(seq), start, F.lit(width))


def context_ok(seq: str | Column, length: int = 101, centre: str = "C") -> Column:
    """Full length, A/C/G/T only, and the expected centre base."""
    return (
        (F.length(_c(seq)) == length)
        & F.regexp_like(_c(seq), F.lit("^[ACGT]+$"))
        & (F.substring(_c(seq), length // 2 + 1, 1) == centre)
    )


def expected_centre(strand: str | Column) -> Column:
    """Base on the reference strand under a transcript-oriented C."""
    return F.when(_c(strand).isin("+", "1", "+1"), "C").otherwise("G")


def allele_rule(strand: str | Column, ref: str | Column, alt: str | Column) -> Column:
    forward = _c(strand).isin("1", "+", "+1") & (_c(ref) == "C") & (_c(alt) == "T")
    backward = _c(strand).isin("-1", "-") & (_c(ref) == "G") & (_c(alt) == "A")
    return F.when(forward | backward, "pass").otherwise("fail")


def site_key(chrom: str | Column, position: str | Column, strand: str | Column) -> Column:
    return F.concat_ws(":", _c(chrom), _c(position).cast("string"), _c(strand), F.lit("C"), F.lit("T"))


def sequence_hash(seq: str | Column) -> Column:
    return F.sha2(_c(seq), 256)


def sequence_id(split: str | Column, key: str | Column, seq_hash: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", _c(split), _c(key), _c(seq_hash)), 256)


def letters(seq: str | Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(_c(seq))), lambda i: F.substring(_c(seq), i, F.lit(1)))


def one_hot(seq: str | Column) -> Column:
    """4 x L indicator matrix, base-major, as one flat array."""

    def indicator(base: str) -> Column:
        return F.transform(letters(seq), lambda c: F.when(c == base, 1.0).otherwise(0.0))

    return F.concat(*[indicator(b) for b in "ACGT"])


def token_ids(seq: str | Column, vocabulary: Mapping[str, int], start: int, end: int, unknown: int) -> Column:
    """Token ids of the letters between a start and an end token."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    inner = F.transform(letters(seq), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown)))
    return F.concat(F.array(F.lit(start)), inner, F.array(F.lit(end)))


def kmers(seq: str | Column, low: int, high: int) -> Column:
    """All k-mers with low <= k <= high, in order of k, then position."""

    def of_length(k: int) -> Column:
        # A sequence shorter than k has no k-mer.
        starts = F.when(F.length(_c(seq)) >= k, F.sequence(F.lit(1), F.length(_c(seq)) - (k - 1)))
        starts = starts.otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(_c(seq), i, F.lit(k)))

    return F.concat(*[of_length(k) for k in range(low, high + 1)])
