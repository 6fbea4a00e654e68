"""Literal goldens for the scalar functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelab.functions import pileup as U
from sitelab.functions import scoring as S
from sitelab.functions import sequences as Q


def measure(spark, *seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    t = Q.tandem_dinucleotide("seq")
    return df.select(
        "seq", Q.base_entropy("seq").alias("e"), Q.longest_run("seq").alias("r"), t["coverage"].alias("c"), t["phase"].alias("p"), t["motif"].alias("m"),
    ).collect()


def test_uniform_sequence_fails_every_rule(spark):
    row = measure(spark, "C" * 101)[0]
    assert (row.e, row.r) == (0.0, 101)
    flags = Q.low_complexity(F.lit(row.e), F.lit(row.r), F.lit(row.c))
    out = spark.range(1).select(*[c.alias(n) for n, c in flags.items()]).first()
    assert out.low_complexity_qc == "FAIL_LOW_COMPLEXITY"
    assert out.triggered_rules == ";".join([Q.ENTROPY_RULE, Q.RUN_RULE, Q.TANDEM_RULE])


def test_tandem_phases(spark):
    first, second = measure(spark, "AC" * 50 + "A", "G" + "AC" * 50)
    assert (first.c, first.p, first.m) == (pytest.approx(100 / 101), 0, "AC")
    assert (second.c, second.p, second.m) == (pytest.approx(100 / 101), 1, "AC")


def slow_tandem(seq):
    """Brute force: every run of equal 2-mers at both phases."""
    best = None
    for phase in (0, 1):
        units = [seq[i : i + 2] for i in range(phase, len(seq) - 1, 2)]
        start = 0
        for i in range(1, len(units) + 1):
            if i == len(units) or units[i] != units[start]:
                candidate = (-2 * (i - start), phase, units[start])
                best = candidate if best is None or candidate < best else best
                start = i
    return -best[0] / len(seq), best[1], best[2]


def test_tandem_against_brute_force(spark):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("AC" if i % 2 else "ACGT"), 101)) for i in range(200)]
    for row in measure(spark, *seqs):
        assert (pytest.approx(row.c), row.p, row.m) == slow_tandem(row.seq)


def test_context_rejects_n_and_wrong_centre(spark):
    good = "A" * 50 + "C" + "G" * 50
    rows = [(good, True), (good[:50] + "G" + good[51:], False), ("N" + good[1:], False), (good[:-1], False)]
    df = spark.createDataFrame(rows, "seq string, want boolean").select(Q.context_ok("seq").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_reverse_complement_and_kmers(spark):
    row = spark.createDataFrame([("AACGT",)], "s string").select(
        Q.reverse_complement("s").alias("r"), Q.kmers("s", 4, 6).alias("k"), Q.centre_crop("s", 3).alias("c")
    ).first()
    assert row.r == "ACGTT" and row.k == ["AACG", "ACGT", "AACGT"] and row.c == "ACG"


def test_pileup_golden(spark):
    df = spark.createDataFrame([(".,Aa^F.$+2tt-1c*<>Nn", "C")], "b string, r string").select(U.base_counts("b", "r").alias("n"))
    n = df.first().n
    assert {b: n[f"{b}_forward"] + n[f"{b}_reverse"] for b in "ACGT"} == {"A": 2, "C": 3, "G": 0, "T": 0}
    assert n["C_reverse"] == 1 and n["A_reverse"] == 1


@pytest.mark.parametrize("raw", ["..X", "+ab", "..1"])
def test_malformed_pileup_is_an_error(raw):
    with pytest.raises(ValueError):
        U.plain_bases(raw)


def exact_fisher(a, b, c, d):
    total, row, col = a + b + c + d, a + b, a + c
    if total == 0:
        return 1.0
    weights = {x: math.comb(col, x) * math.comb(total - col, row - x) for x in range(max(0, row + col - total), min(row, col) + 1)}
    return sum(w for w in weights.values() if w <= weights[a]) / sum(weights.values())


def test_fisher_against_integers(spark):
    rng = np.random.default_rng(3)
    tables = [(1, 9, 11, 3), (0, 0, 0, 0)] + [tuple(int(v) for v in rng.integers(0, 60, 4)) for _ in range(100)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in df.select("*", U.fisher_exact("a", "b", "c", "d").alias("p")).collect():
        assert r.p == pytest.approx(exact_fisher(r.a, r.b, r.c, r.d), rel=1e-8)


def test_log_factorial_series():
    n = np.array([0, 5, 255, 256, 1000, 10**6])
    assert np.allclose(U.log_factorial(n), [math.lgamma(v + 1) for v in n], rtol=1e-13)


def test_hash_uniform_matches_hashlib(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42|x7").digest()[:8], "big") / 2**64
    assert spark.createDataFrame([("x7",)], "k string").select(S.hash_uniform("k", 42).alias("u")).first().u == want


def test_bins(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (8.0, 3), (20.0, 4), (1e9, 12)], "d double, want long")
    assert all(r.got == r.want for r in df.select(S.depth_bin("d").alias("got"), "want").collect())
