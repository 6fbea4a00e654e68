"""Operators against literal goldens and brute force on small fixtures."""

import functools
import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelab.operators import calibrate as C
from sitelab.operators import components as K
from sitelab.operators import intervals as I
from sitelab.operators import learn as N
from sitelab.operators import newton as G
from sitelab.operators import pairs as Q
from sitelab.operators import ranking as R
from sitelab.operators import replicates as A
from sitelab.operators import sampling as M
from sitelab.operators import skew
from sitelab.operators import splits as P
from sitelab.operators import stats as W
from sitelab.operators.ordering import Ordered, Scan, global_rank, top_k
from sitelab.plans import flows


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_benjamini_hochberg_golden(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, None), (3, 0.03)], "i int, p double")
    got = dict(rows(W.benjamini_hochberg(df, "p"), "i", "fdr"))
    assert got == {0: pytest.approx(0.03), 1: pytest.approx(0.04), 2: None, 3: pytest.approx(0.04)}


def test_merge_golden(spark):
    df = spark.createDataFrame([("c", 5, 10), ("c", 1, 3), ("c", 3, 5), ("c", 20, 21)], "chrom string, start0 long, end0 long")
    assert rows(I.merge_intervals(df, ["chrom"]), "start0", "end0") == [(1, 10), (20, 21)]


def test_subtract_and_overlap_against_bases(spark):
    rng = random.Random(1)
    make = lambda n: [("c", s, s + rng.randint(1, 30)) for s in (rng.randint(0, 400) for _ in range(n))]
    a, b = make(25), make(15)
    schema = "chrom string, start0 long, end0 long"
    left = {p for _, s, e in a for p in range(s, e)} - {p for _, s, e in b for p in range(s, e)}
    got = rows(I.subtract_intervals(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["chrom"]), "start0", "end0")
    assert {p for s, e in got for p in range(s, e)} == left
    assert all(e < s2 for (_, e), (s2, _) in zip(got, got[1:]))
    points = spark.createDataFrame([("c", p) for p in range(0, 440)], "chrom string, position long")
    hits = I.points_in_intervals(points, spark.createDataFrame(a, schema), ["chrom"], "position", width=16)
    want = sorted((p, s, e) for p in range(440) for _, s, e in a if s <= p < e)
    assert rows(hits, "position", "start0", "end0") == want


def test_proximity_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(I, "HALO_BIN", 64)
    rng = random.Random(2)
    points = sorted({rng.randint(0, 3000) for _ in range(200)})
    centres = sorted({rng.randint(0, 3000) for _ in range(40)})
    p = spark.createDataFrame([("c", x) for x in points], "chrom string, position long")
    c = spark.createDataFrame([("c", x) for x in centres], "chrom string, position long")
    want = [x for x in points if any(abs(x - y) <= 20 for y in centres)]
    assert [r[0] for r in rows(I.near_centres(p, c, ["chrom"], "position", 20), "position")] == want
    pairs = [(b, a) for a, b in zip(points, points[1:]) if b - a <= 20]
    assert rows(I.neighbour_pairs(p, ["chrom"], "position", 20), "position", "previous") == pairs


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ranks_and_scans_do_not_depend_on_layout(spark, partitions):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(data, "i int, g string, x int").repartition(partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        ranked = {r.i: r["rank"] for r in global_rank(df, ["-x", "i"], by=["g"]).collect()}
        scanned = {
            r.i: (r.s, r.m, r.t)
            for r in Ordered(df, ["x", "i"], ["g"])
            .scan(s=Scan("sum", "x"), m=Scan("min", "i", reverse=True, exclusive=True), t=Scan("sum", "x", whole=True))
            .frame()
            .collect()
        }
        top = [r.i for r in top_k(df, 30, ["-x", "i"]).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in "ab":
        order = sorted((d for d in data if d[1] == g), key=lambda d: (-d[2], d[0]))
        assert [ranked[d[0]] for d in order] == list(range(1, len(order) + 1))
        order = sorted((d for d in data if d[1] == g), key=lambda d: (d[2], d[0]))
        total = sum(d[2] for d in order)
        run = 0
        for k, d in enumerate(order):
            run += d[2]
            later = [e[0] for e in order[k + 1 :]]
            assert scanned[d[0]] == (run, min(later) if later else None, total)
    assert sorted(top) == sorted(d[0] for d in sorted(data, key=lambda d: (-d[2], d[0]))[:30])


def test_key_counts_with_a_hot_key(spark):
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)]
    df = spark.createDataFrame(data, "i int, k string")
    got = {r.i: r.n for r in skew.with_key_count(df, ["k"], "n").collect()}
    counts = defaultdict(int)
    for _, k in data:
        counts[k] += 1
    assert got == {i: counts[k] for i, k in data}


def test_null_groups_and_keys_are_kept(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 3), (3, None, 4), (4, "a", 5)], "i int, g string, x int")
    assert rows(global_rank(df, ["x", "i"], by=["g"]), "i", "rank") == [(1, 1), (2, 1), (3, 2), (4, 2)]
    scanned = Ordered(df, ["x", "i"], ["g"]).scan(s=Scan("sum", "x")).frame()
    assert rows(scanned, "i", "s") == [(1, 5), (2, 3), (3, 7), (4, 10)]
    assert rows(skew.with_key_count(df, ["g", "x"], "n"), "i", "n") == [(1, 2), (2, 1), (3, 1), (4, 2)]


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(14)
    values = rng.integers(0, 30, 501) / 7
    df = spark.createDataFrame([("m", float(v)) for v in values], "g string, x double")
    levels = [0.0, 0.05, 1 / 3, 0.5, 0.951, 1.0]
    got = [r.value for r in W.quantiles(df, ["g"], ["x"], levels).orderBy("level").collect()]
    assert np.allclose(got, np.quantile(values, levels))


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(7, x) for x in range(301, 420)] + [(i, i + 1) for i in range(500, 560)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in K.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[n] == find(n) for e in edges for n in e if e[0] != e[1])


def test_group_digests_follow_the_set_of_keys(spark):
    df = spark.createDataFrame([(f"k{i}", "g") for i in range(30)] + [("z", "h")], "key string, grp string")
    got = dict(rows(K.group_digests(df, "key", "grp"), "grp", "group_id"))
    digests = [hashlib.sha256(f"k{i}".encode()).hexdigest() for i in range(30)]
    text = "|".join(["30", *[str(sum(int(d[i : i + 8], 16) for d in digests)) for i in range(0, 64, 8)]])
    assert got["g"] == "LG_" + hashlib.sha256(text.encode()).hexdigest()[:16]
    assert dict(rows(K.group_digests(df.repartition(5), "key", "grp"), "grp", "group_id")) == got
    fewer = dict(rows(K.group_digests(df.filter("key != 'k3'"), "key", "grp"), "grp", "group_id"))
    assert fewer["g"] != got["g"] and fewer["h"] == got["h"]


def test_missing_genes_keep_the_other_links(spark):
    schema = "site_key long, genes array<string>, seq string, chrom string, position long, strand string"
    data = [
        (1, ["G"], "AAA", "c1", 10, "+"), (2, None, "AAA", "c1", 5000, "+"), (3, ["NA", ""], "AAA", "c2", 10, "+"),
        (4, ["NA"], "CCC", "c3", 10, "+"), (5, ["-", None, "G"], "GGG", "c4", 10, "+"), (6, None, "TTT", "c5", 10, "+"),
    ]
    got = dict(rows(K.leakage_components(spark.createDataFrame(data, schema)), "site_key", "component"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6}


@pytest.mark.parametrize("seed, quota, total", [(1, 12, 40), (2, 30, 75), (3, 6, 24)])
def test_quotas_while_thinning_equal_the_walk(spark, seed, quota, total):
    """Crowded rows: strata that fall short, rows behind a full quota that must not block, and a refill."""
    rng = random.Random(seed)
    data = [(i, f"chr{rng.randint(1, 2)}", rng.randint(1, 9000), f"S{rng.randint(0, 300)}", rng.choice("aaabbcd")) for i in range(400)]
    df = spark.createDataFrame(data, "id long, chrom string, position long, seq string, g string")
    wanted = {"a": quota, "b": quota, "c": quota, "d": quota, "none": 3}
    quotas = spark.createDataFrame(list(wanted.items()), "g string, n long")
    taken, seqs, places = [], set(), defaultdict(list)

    def walk(rows_, most):
        n = 0
        for i, chrom, position, seq, _ in rows_:
            if n < most and seq not in seqs and all(abs(position - p) > 60 for p in places[chrom]):
                taken.append(i)
                seqs.add(seq)
                places[chrom].append(position)
                n += 1

    by = lambda tag: lambda d: hashlib.sha256(f"42|{tag}|{d[0]}".encode()).hexdigest()
    for g in "abcd":
        walk(sorted((d for d in data if d[4] == g), key=by("thin")), wanted[g])
    walk(sorted((d for d in data if d[0] not in taken), key=by("fill")), total - len(taken))
    args = (df, "id", "chrom", "position", "seq", 60, ["g"], quotas)
    if len(taken) < total:
        with pytest.raises(ValueError, match="available"):
            M.thin_to_quotas(*args, total, 42)
        total = len(taken)
    assert {r.id for r in M.thin_to_quotas(*args, total, 42).collect()} == set(taken)


def test_refill_over_stored_rows_sees_few_of_them(spark, tmp_path, monkeypatch):
    """Rows read from files, as the query reads them; a quota far below the pool thins some of it only."""
    rng = random.Random(5)
    data = [(i, "chr1", rng.randint(1, 400_000), f"S{rng.randint(0, 3000)}", rng.choice("ab")) for i in range(6000)]
    spark.createDataFrame(data, "id long, chrom string, position long, seq string, g string").write.parquet(str(tmp_path / "pool"))
    df = spark.read.parquet(str(tmp_path / "pool")).filter("id >= 0")
    quotas = spark.createDataFrame([("a", 10), ("b", 5)], "g string, n long")
    seen, thin = [], M.thin
    monkeypatch.setattr(M, "thin", lambda rows_, *rest: seen.append(rows_.count()) or thin(rows_, *rest))
    got = {r.id for r in M.thin_to_quotas(df, "id", "chrom", "position", "seq", 20, ["g"], quotas, 25, 42).collect()}
    assert max(seen) < 600
    taken = []

    def walk(tag, rows_, most):
        for d in sorted(rows_, key=lambda d: hashlib.sha256(f"42|{tag}|{d[0]}".encode()).hexdigest()):
            if most and all(abs(d[2] - t[2]) > 20 and d[3] != t[3] for t in taken):
                taken.append(d)
                most -= 1

    walk("thin", [d for d in data if d[4] == "a"], 10)
    walk("thin", [d for d in data if d[4] == "b"], 5)
    walk("fill", [d for d in data if d not in taken], 10)
    assert got == {d[0] for d in taken}


def test_nulls_lose_and_shortage_is_an_error(spark):
    grid = spark.createDataFrame([("a", None, 1), ("a", 0.5, 2), ("b", None, 3)], "g string, ap double, i int")
    assert rows(W.best_of_grid(grid, ["g"], ["ap"]), "g", "i") == [("a", 2), ("b", 3)]
    assert rows(skew.first_by(grid, ["g"], [-F.col("ap")]), "g", "i") == [("a", 2), ("b", 3)]
    methods = spark.createDataFrame([("m", "platt", None, 0.1), ("m", "isotonic", 0.2, None)], "m string, method string, brier double, ece double")
    assert rows(C.choose_method(methods, ["m"]), "m", "method") == [("m", "isotonic")]
    pool = spark.createDataFrame([(1, "s", "h1", 0.1), (2, "s", "h1", 0.2)], "id long, g string, sequence_hash string, x double")
    with pytest.raises(ValueError, match="hard negatives wanted"):
        N.mine_hard_negatives(pool, lambda b: b["x"].to_numpy(), ["x"], 2)
    with pytest.raises(ValueError, match="without sequence_hash"):
        N.mine_hard_negatives(pool.withColumn("sequence_hash", F.lit(None).cast("string")), lambda b: b["x"].to_numpy(), ["x"], 1)
    quotas = spark.createDataFrame([("s", 1)], "g string, n long")
    placed = pool.withColumns({"chrom": F.lit("chr1"), "position": F.col("id") * 1000})
    with pytest.raises(ValueError, match="3 rows wanted, 1 available"):
        M.thin_to_quotas(placed, "id", "chrom", "position", "sequence_hash", 5, ["g"], quotas, 3, 1)
    sites = spark.createDataFrame([(1, "dev", 1), (2, "dev", 0)], "id long, split string, label int")
    with pytest.raises(ValueError, match="no set of 1 to 5"):
        P.ratio_set(sites, "dev", 5, "id", fit_positives=True)


def test_endless_numbers_are_printed(spark):
    from sitelab.sources.sinks import printable

    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (0.25,), (None,)], "x double")
    assert [r.x for r in printable(df).collect()] == ["inf", "-inf", "NA", "0.25", "NA"]


def test_numbers_are_rounded_by_their_exact_value(spark):
    """The shortest text of these ends in a 5 behind the twelfth digit; the double is a little less, more, or just that."""
    from sitelab.sources.sinks import printable

    data = [0.1234567890125, 0.1234567890135, 1.000000000005, 0.5000000000005, 1234567890.125, -2.000000000015, 1e-7, 1e15, -0.0, 123456789012.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x double")
    assert [r.x for r in printable(df).orderBy(F.col("i").cast("int")).collect()] == [f"{x + 0.0:.12g}" for x in data]


def test_covering_values_equal_all_pairs(spark):
    """Deep cover, edges on bin borders, empty intervals and NULL ids; the plan joins points to bins, never to intervals."""
    from sitelab.operators import intervals as I

    rng = random.Random(4)
    spans = [(f"chr{rng.randint(1, 2)}", a := rng.choice([rng.randint(0, 600), 64 * rng.randint(0, 9)]), a + rng.choice([0, 1, 64, 100, 300]), rng.choice(["x", "y", "z", None])) for _ in range(400)]
    dots = [(i, f"chr{rng.randint(1, 3)}", rng.randint(0, 900)) for i in range(300)]
    points = spark.createDataFrame(dots, "id long, chrom string, at long")
    df = spark.createDataFrame(spans, "chrom string, start0 long, end0 long, name string")
    found = I.covering_values(points, df, ["chrom"], "at", ["name"], width=64)
    got = sorted((r.id, r.name, r.hits) for r in found.collect())
    want = []
    for i, chrom, at in dots:
        around = [s for s in spans if s[0] == chrom and s[1] <= at < s[2]]
        if around:
            want.append((i, ",".join(sorted({s[3] for s in around if s[3]})), len(around)))
    assert got == sorted(want)


def test_gene_coverage_golden(spark):
    data = [("a", 1, 4.0, ["G1"]), ("b", 0, 12.0, ["G1", "G2"]), ("c", 0, 52.0, ["G2"])]
    df = spark.createDataFrame(data, "key string, label int, median_depth double, genes array<string>")
    table = A.gene_coverage(df)
    assert rows(table, "gene_id", "mean_site_median_depth") == [("G1", 8.0), ("G2", 32.0)]
    out = {r.key: r for r in A.site_gene_coverage(df, table, "key").collect()}
    assert out["b"].gene_level_coverage == 20.0 and out["b"].gene_level_coverage_bin == 4


def test_split_of_single_sites_is_balanced(spark):
    data = [
        (f"s{i}", f"g{i}", int(i < 100), "chr1" if i % 2 else "chr2", "exonic", 0.5, 0.2 if i < 100 else 0.0) for i in range(1000)
    ]
    df = spark.createDataFrame(data, "site_key string, grp string, label int, chrom string, region string, gc double, efficiency double")
    split = df.join(P.split_groups(df, "grp"), "grp")
    total = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    positive = {r.split: r["count"] for r in split.filter("label = 1").groupBy("split").count().collect()}
    assert positive == {"train": 70, "dev": 10, "calibration": 10, "test": 10}
    for name, want in {"train": 700, "dev": 100, "calibration": 100, "test": 100}.items():
        assert abs(total[name] - want) <= 2


def test_split_with_one_huge_group(spark):
    data = [(f"s{i}", "huge" if i < 3300 else f"g{i % 1500}", int(i % 20 == 0), f"chr{i % 5}", "coding", (i % 10) / 10, 0.3) for i in range(10000)]
    df = spark.createDataFrame(data, "site_key string, grp string, label int, chrom string, region string, gc double, efficiency double")
    placed = P.split_groups(df, "grp")
    assert placed.count() == df.select("grp").distinct().count()
    split = df.join(placed, "grp")
    share = {r.split: r["count"] / 10000 for r in split.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.03 and all(abs(share[s] - 0.1) < 0.03 for s in ("dev", "calibration", "test"))


def test_split_is_balanced_in_every_feature(spark):
    """Groups of all sizes, some of them just above and below a hundredth, keep every feature near its shares."""
    rng = random.Random(4)
    data, n = [], 20000
    for i in range(n):
        grp = f"b{rng.randrange(8)}" if rng.random() < 0.4 else f"g{int(rng.paretovariate(1.2) * 40) if rng.random() < 0.5 else i}"
        region = rng.choice(["utr", "intron", "missense", "x", None])
        data.append((f"s{i}", grp, int(rng.random() < 0.15), f"chr{rng.randrange(6)}", region, rng.random(), rng.random() * 0.6))
    df = spark.createDataFrame(data, "site_key string, grp string, label int, chrom string, region string, gc double, efficiency double")
    held = P.group_features(df, "grp").join(P.split_groups(df, "grp"), "grp").groupBy("feature", "split").sum("c").collect()
    totals, most = {}, {}
    for r in P.group_features(df, "grp").groupBy("feature").agg(F.sum("c"), F.max("c")).collect():
        totals[r[0]], most[r[0]] = r[1], r[2]
    found = {(r[0], r[1]): r[2] for r in held}
    for feature, total in totals.items():
        for split, pct in P.PERCENT.items():
            miss = abs(found.get((feature, split), 0) - total * pct / 100)
            assert miss <= max(8, 0.05 * total, most[feature]), (feature, split, miss, total, most[feature])


def sites_for_leakage(spark, n=400):
    rng = random.Random(6)
    data = [
        (i, f"chr{rng.randint(1, 2)}", rng.randint(1, 40000), rng.choice("+-"), int(rng.random() < 0.2), f"S{rng.randint(0, 900)}", [f"G{rng.randint(0, 250)}"])
        for i in range(n)
    ]
    df = spark.createDataFrame(data, "site_key long, chrom string, position long, strand string, label int, seq string, genes array<string>")
    return data, df.withColumns({"region": F.lit("utr"), "gc": F.lit(0.4), "efficiency": F.lit(0.2)})


def test_leakage_groups_and_suite(spark):
    from sitelab.operators import quality as Y

    data, df = sites_for_leakage(spark)
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    seen = {}
    for i, chrom, position, strand, _, seq, genes in data:
        for k in [("g", genes[0]), ("s", seq), ("c", chrom, position)]:
            join(i, seen.setdefault(k, i))
    for key in {(d[1], d[3]) for d in data}:
        order = sorted((d[2], d[0]) for d in data if (d[1], d[3]) == key)
        for (p, a), (q, b) in zip(order, order[1:]):
            if q - p <= 100:
                join(a, b)
    got = {r.site_key: r.component for r in K.leakage_components(df).collect()}
    assert got == {d[0]: find(d[0]) for d in data}
    split = flows.split_sites(df)
    assert split.count() == len(data)
    assert all(r.status == "PASS" for r in Y.leakage_suite(split).collect())


def test_thinning_equals_sequential_greedy(spark):
    rng = random.Random(8)
    data = [(i, f"chr{rng.randint(1, 2)}", rng.randint(1, 6000), f"S{rng.randint(0, 120)}") for i in range(300)]
    df = spark.createDataFrame(data, "id long, chrom string, position long, seq string")
    got = {r.id for r in M.thin(df, "id", "chrom", "position", "seq", 60, 42).collect()}
    order = sorted(data, key=lambda d: hashlib.sha256(f"42|thin|{d[0]}".encode()).hexdigest())
    kept, seqs, places = set(), set(), defaultdict(list)
    for i, chrom, position, seq in order:
        if seq not in seqs and all(abs(position - p) > 60 for p in places[chrom]):
            kept.add(i)
            seqs.add(seq)
            places[chrom].append(position)
    assert got == kept


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_sample_is_the_sorted_prefix(spark, monkeypatch, digits):
    """Groups with fewer rows than wanted, just as many, none wanted, and edges at every depth."""
    monkeypatch.setattr(M, "CELL_DIGITS", digits)
    data = [(i, "abcd"[min(3, i // 700)]) for i in range(2200)]
    df = spark.createDataFrame(data, "id long, g string")
    order = {g: sorted((i for i, h in data if h == g), key=lambda i: hashlib.sha256(f"{M.SEED}|t|{i}".encode()).hexdigest()) for g in "abcd"}
    for wanted in ({"a": 5, "b": 700, "c": 0, "d": 900}, {"a": 699, "b": 1, "c": 350}, {"a": 256, "b": 16, "c": 17, "d": 99}):
        quotas = spark.createDataFrame(list(wanted.items()), "g string, n long")
        got = M.hash_sample(df.repartition(5), quotas, ["g"], "id", "t")
        assert rows(got, "g", "id") == sorted((g, i) for g, n in wanted.items() for i in order[g][:n])


@pytest.mark.parametrize("count, epoch", [(90, 0), (90, 3), (90, 4), (400, 1), (500, 2), (400, 0)])
def test_slices_rotate_through_one_permutation(spark, count, epoch):
    df = spark.createDataFrame([(i,) for i in range(400)], "id long").repartition(3)
    order = sorted(range(400), key=lambda i: hashlib.sha256(f"{7 + M.PERMUTATION_STEP}|permutation|{i}".encode()).hexdigest())
    start = epoch * count % 400
    want = [(order[(start + n) % 400], n) for n in range(min(count, 400))]
    assert rows(M.rotating_slice(df, count, epoch, "id", 7), "id", "slot") == sorted(want)


def test_top_rows_by_any_kind_of_column(spark, monkeypatch):
    """Texts with long common starts, one value for most rows, numbers of very unequal spread, NULLs at either end."""
    from sitelab.operators import ordering

    monkeypatch.setattr(ordering, "FEW", 20)
    rng = random.Random(1)
    data = [
        (i, rng.choice(["chr1", "chr1", "chr1", "chr10", "chr2", "", None, "x"]), rng.choice([None, 0.0, 1e12, rng.random(), -5.0]), f"common start {rng.randrange(40):03d}")
        for i in range(500)
    ]
    df = spark.createDataFrame(data, "i long, t string, x double, s string")

    def first(k, order):
        def key(r):
            parts = []
            for c in order:
                v, down = r["itxs".index(c.lstrip("-"))], c.startswith("-")
                parts.append((v is not None, v) if not down else (v is None, Reversed(v)))
            return parts

        return sorted(r[0] for r in sorted(data, key=key)[:k])

    for order in (["t", "x", "i"], ["-t", "-x", "i"], ["-x", "s", "i"], ["s", "-i"]):
        for k in (40, 333):
            assert sorted(r.i for r in top_k(df, k, order).collect()) == first(k, order), (order, k)
    assert top_k(df, 0, ["t", "i"]).count() == 0 and top_k(df, 900, ["t", "i"]).count() == 500


@functools.total_ordering
class Reversed:
    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        return self.v == other.v

    def __lt__(self, other):
        return other.v is not None and self.v is not None and other.v < self.v


def test_draws_repeat_only_when_short(spark):
    pool = spark.range(10)
    assert len({r.id for r in M.draw(pool, 10, "t", "id", 1).collect()}) == 10
    counts = M.draw(pool, 25, "t", "id", 1).groupBy("id").count().collect()
    assert sorted(r["count"] for r in counts) == [2] * 5 + [3] * 5
    with pytest.raises(ValueError):
        M.draw(pool, 11, "t", "id", 1, repeat=False)


def test_rotating_slice_wraps(spark):
    pool = spark.range(10)
    slices = [[r.id for r in M.rotating_slice(pool, 4, e, "id", 1).orderBy("slot").collect()] for e in range(5)]
    flat = [x for s in slices for x in s]
    assert flat[:10] == flat[10:20] and sorted(flat[:10]) == list(range(10))


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(9)
    score = rng.integers(0, 12, 300) / 12
    label = (rng.random(300) < score * 0.5).astype(int)
    df = spark.createDataFrame([("m", i, int(y), float(s)) for i, (y, s) in enumerate(zip(label, score))], "model_id string, id long, label int, score double")
    m = R.ranking_metrics(df).first()
    positives = label.sum()
    ap = auc = 0.0
    previous = 0
    for s in sorted(set(score), reverse=True):
        tp, n = label[score >= s].sum(), (score >= s).sum()
        ap += (tp - previous) / positives * tp / n
        previous = tp
    for a in score[label == 1]:
        auc += ((score[label == 0] < a).sum() + 0.5 * (score[label == 0] == a).sum()) / (positives * (300 - positives))
    discount = 1 / np.log2(np.arange(300) + 2)
    order = np.argsort(-score, kind="stable")
    dcg = sum(discount[score[order] == s].mean() * label[score == s].sum() for s in set(score))
    assert m.average_precision == pytest.approx(ap) and m.roc_auc == pytest.approx(auc)
    assert m.ndcg == pytest.approx(dcg / discount[:positives].sum())
    assert m.discovered_at_50 == label[order[:50]].sum()


def test_fp_budget_limits(spark):
    data = [("m", i, 0, i / 10) for i in range(10)] + [("m", 100, 1, 0.95), ("m", 101, 1, 0.65)]
    df = spark.createDataFrame(data, "model_id string, id long, label int, score double")
    got = {r.target_fp_per_million: (r.allowed_fp, r.exceed_score, r.tp, r.fp) for r in R.fp_budget_threshold(df, [10, 300000, 1000000]).collect()}
    assert got == {10: (0, 0.9, 1, 0), 300000: (3, 0.6, 2, 3), 1000000: (10, None, 2, 10)}


def newton_logistic(x, y, c, intercept=True):
    """Plain Newton iterations for the penalised likelihood."""
    X = np.column_stack([x, np.ones(len(y))]) if intercept else x
    penalty = np.full(X.shape[1], 1 / c)
    if intercept:
        penalty[-1] = 0
    w = np.zeros(X.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ w))
        gradient = X.T @ (p - y) + penalty * w
        hessian = (X * (p * (1 - p))[:, None]).T @ X + np.diag(penalty)
        w = w - np.linalg.solve(hessian, gradient)
    return w


def calibration_data(spark, n=600):
    rng = np.random.default_rng(10)
    score = rng.random(n)
    label = (rng.random(n) < score**2).astype(int)
    df = spark.createDataFrame([(i, float(s), int(y), f"g{i % 60}") for i, (s, y) in enumerate(zip(score, label))], "id long, score double, label int, grp string")
    return score, label, df


def test_platt_against_newton(spark):
    score, label, df = calibration_data(spark)
    fitted = C.fit_platt(df).fits.first()
    w = newton_logistic(np.log(score / (1 - score))[:, None], label, 1e6)
    assert (fitted.slope, fitted.intercept) == (pytest.approx(w[0], rel=1e-6), pytest.approx(w[1], rel=1e-6, abs=1e-8))
    falling = spark.createDataFrame([("a", 2.0, 0.0), ("b", -1.0, 0.0)], "model_id string, slope double, intercept double")
    with pytest.raises(ValueError, match="'b'"):
        C.require_increasing(C.Platt(falling, ("model_id",)))


def test_grouped_fits_equal_single_ones(spark):
    """Many fits in one pass, a separable and a one-class group and a NULL key among them."""
    rng = np.random.default_rng(3)
    data = []
    for key, bend in (("a", 1.0), ("b", 3.0), (None, 0.5)):
        for s in rng.random(150):
            data.append((key, float(s), int(rng.random() < s**bend)))
    data += [("apart", i / 20, int(i >= 10)) for i in range(20)] + [("ones", i / 20, 1) for i in range(20)]
    df = spark.createDataFrame(data, "k string, score double, label int")
    fits = {r.k: (r.slope, r.intercept) for r in C.fit_platt(df, by=["k"]).fits.collect()}
    assert set(fits) == {"a", "b", None, "apart", "ones"}
    for key in ("a", "b", None):
        mine = [(s, y) for k, s, y in data if k == key]
        x, y = np.array([s for s, _ in mine]), np.array([v for _, v in mine])
        x = np.clip(x, 1e-7, 1 - 1e-7)
        w = newton_logistic(np.log(x / (1 - x))[:, None], y, 1e6)
        assert fits[key] == (pytest.approx(w[0], rel=1e-5), pytest.approx(w[1], rel=1e-4, abs=1e-6))
    assert fits["apart"][0] > 10 and all(math.isfinite(v) for pair in fits.values() for v in pair)
    got = C.fit_isotonic(df, by=["k"]).points.collect()
    for key in ("a", "b", None, "apart"):
        mine = [(s, y) for k, s, y in data if k == key]
        xs, ys = pool_adjacent(np.array([s for s, _ in mine]), np.array([float(v) for _, v in mine]))
        points = sorted((r.x, r.y) for r in got if r.k == key)
        assert np.allclose(np.interp(xs, *zip(*points)), ys, atol=1e-9)


@pytest.mark.parametrize("shape", ["rising", "falling", "noisy", "steps"])
def test_isotonic_over_many_ranges(spark, shape):
    """Ranges of four blocks give the same fit as one pass, also where violations reach over all of them."""
    n = 90
    rng = np.random.default_rng(5)
    x = np.arange(n) / n
    y = {"rising": x, "falling": 1 - x, "noisy": (rng.random(n) < x).astype(float), "steps": np.floor(x * 5) / 5 + (rng.random(n) < 0.3)}[shape]
    df = spark.createDataFrame([("k" if i % 2 else "j", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k string, score double, label double")
    points = C.fit_isotonic(df, clip=False, by=["k"], size=4).points.collect()
    for key, odd in (("k", 1), ("j", 0)):
        xs, ys = pool_adjacent(x[odd::2], y[odd::2])
        mine = sorted((r.x, r.y) for r in points if r.k == key)
        assert np.allclose(np.interp(xs, *zip(*mine)), ys, atol=1e-9)


def test_frozen_parameters_score_in_another_session(spark, tmp_path):
    from sitelab.sources.frozen import Frozen, freeze_calibrators, freeze_thresholds, freeze_weights

    _, _, df = calibration_data(spark, 200)
    df = df.crossJoin(spark.createDataFrame([("p",), ("i",), ("n",)], "model_id string"))
    by, folder = ["model_id"], str(tmp_path / "frozen")
    platt, iso = C.fit_platt(df, by=by), C.fit_isotonic(df, by=by)
    chosen = spark.createDataFrame([("p", "platt"), ("i", "isotonic"), ("n", "none")], "model_id string, method string")
    freeze_calibrators(folder, chosen, platt, iso)
    freeze_thresholds(folder, spark.createDataFrame([("p", 10, 0.5), ("i", 10, None)], "model_id string, target_fp_per_million long, exceed_score double"))
    freeze_weights(spark, folder, "lin", ["a", "b"], [2.0, -1.0], 0.5)
    other = spark.newSession()
    store = Frozen(other, folder)
    rows_ = other.createDataFrame([(m, i, s) for m in ("p", "i", "n", "unknown") for i, s in enumerate([0.0, 0.3, 0.7, 1.0])], "model_id string, id long, score double")
    got = {(r.model_id, r.id): (r.probability, r.called) for r in store.called(store.calibrated(rows_), 10).collect()}
    assert len(got) == 16 and got["unknown", 0] == (None, None) and got["n", 0] == (pytest.approx(1e-7), None)
    fit = {r.model_id: r for r in platt.fits.collect()}["p"]
    want = 1 / (1 + math.exp(-(fit.slope * math.log(0.7 / 0.3) + fit.intercept)))
    assert got["p", 2] == (pytest.approx(want), want > 0.5)
    direct = C.apply_method(df.filter("model_id = 'i'").select("model_id", "id", "score"), "isotonic", iso, "score", "q")
    again = store.calibrated(other.createDataFrame(direct.toPandas()))
    assert again.filter("abs(q - probability) > 1e-12").count() == 0 and got["i", 1][1] is True
    table = other.createDataFrame([(1, 3.0, 1.0)], "id long, x double, y double")
    assert store.linear(table, "lin", {"a": F.col("x"), "b": F.col("y")}).first().score == 5.5
    long = other.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "b", 1.0)], "id long, feature string, value double")
    assert sorted(map(tuple, store.linear_long(long, "id").collect())) == [(1, "lin", 5.5), (2, "lin", -0.5)]
    with pytest.raises(ValueError, match="other features"):
        store.linear(table, "lin", {"a": F.col("x")})
    with pytest.raises(ValueError, match="frozen already"):
        freeze_weights(spark, folder, "lin", ["a"], [1.0], 0.0)
    with pytest.raises(ValueError, match="more than one"):
        freeze_calibrators(str(tmp_path / "twice"), chosen.unionByName(chosen), platt, iso)


def test_comparison_of_methods_takes_few_jobs(spark):
    _, _, df = calibration_data(spark, 300)
    pred = df.crossJoin(spark.createDataFrame([("p",), ("q",), ("r",)], "model_id string"))
    spark.sparkContext.setJobGroup("comparison", "jobs of one comparison")
    try:
        assert flows.calibration_comparison(pred, 5, 42).count() == 9
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("comparison")) <= 90
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def pool_adjacent(x, y):
    order = np.argsort(x)
    blocks = []
    for v in y[order]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return x[order], np.concatenate([[v] * n for v, n in blocks])


def test_isotonic_and_its_application(spark):
    score, label, df = calibration_data(spark)
    xs, ys = pool_adjacent(score, label.astype(float))
    fitted = C.fit_isotonic(df)
    probes = np.random.default_rng(11).random(200)
    other = spark.createDataFrame([(i, float(s)) for i, s in enumerate(probes)], "id long, score double")
    got = {r.id: r.p for r in C.apply_method(other, "isotonic", fitted, "score", "p").collect()}
    want = np.interp(probes, xs, ys)
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-9)


def test_grouped_folds_are_atomic_and_even(spark):
    _, label, df = calibration_data(spark)
    dealt = P.grouped_folds(df, "label", "grp", 5, 42)
    assert dealt.groupBy("grp").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    positives = [r["count"] for r in dealt.filter("label = 1").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 600 and max(sizes) <= 1.2 * min(sizes)
    assert max(positives) - min(positives) <= 0.3 * label.sum() / 5


def test_out_of_fold_covers_every_row(spark):
    _, _, df = calibration_data(spark)
    dealt = P.grouped_folds(df, "label", "grp", 5, 42)
    oof = C.out_of_fold(dealt, "platt", 5)
    assert oof.count() == 600 and oof.select("id").distinct().count() == 600


def test_composition_logistic_against_newton(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 2)) * [3, 0.5] + [1, 2]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, a double, b double, label int")
    score = N.numeric_logistic(df, "label", ["a", "b"])
    got = np.array([r.score for r in score(df).orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = newton_logistic(z, y, 1.0)
    assert np.allclose(got, z @ w[:2] + w[2], atol=1e-3)


def test_pairwise_ranker_learns_a_motif(spark):
    rng = random.Random(13)
    make = lambda motif: "".join(rng.choice("ACGT") for _ in range(40)) + motif + "".join(rng.choice("ACGT") for _ in range(40))
    data = [(i, make("GATTACA") if i % 2 else make("ACGCTTG"), i % 2, rng.random()) for i in range(120)]
    df = spark.createDataFrame(data, "id long, seq string, label int, gc double")
    pairs = spark.createDataFrame([(2 * i + 1, 2 * i) for i in range(40)], "positive_id long, negative_id long")
    score, weights = N.pairwise_ranker(df.filter("id < 80"), pairs, "id", ["gc"])
    dev = score(df.filter("id >= 80")).select(F.lit("m").alias("model_id"), "id", "label", "score")
    assert R.area_metrics(R.score_table(dev)).first().average_precision > 0.95
    assert len(weights) > 100


def test_scorer_must_be_finite_and_complete(spark):
    df = spark.range(20)
    assert N.score_rows(df, lambda b: b["id"].to_numpy() * 0.5, ["id"]).agg(F.sum("score")).first()[0] == 95.0
    for bad in (lambda b: np.full(len(b), np.nan), lambda b: np.zeros(1 + len(b))):
        with pytest.raises(Exception, match="scorer returned"):
            N.score_rows(df, bad, ["id"]).collect()


def test_quotas_by_largest_remainder(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, m long")
    assert rows(M.largest_remainder(df, ["k"], "m", 7), "k", "n") == [("a", 4), ("b", 2), ("c", 1)] or math.isclose(
        sum(r.n for r in M.largest_remainder(df, ["k"], "m", 7).collect()), 7
    )


def test_incomplete_beta_and_p_values(spark):
    """Against the closed forms for whole and half parameters and numerical integration."""
    cases = [(2.0, 3.0, 0.3), (0.5, 0.5, 0.2), (5.0, 1.0, 0.9), (1.0, 4.0, 0.05), (150.0, 0.5, 0.999), (150.0, 0.5, 0.97), (3.0, 2.0, 0.0), (3.0, 2.0, 1.0)]
    df = spark.createDataFrame(cases, "a double, b double, x double")
    got = [r.v for r in df.select(W.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("v")).collect()]

    def integral(a, b, x):
        # u = x * s**(1/a) takes the pole at 0 out of the integrand.
        s = (np.arange(400_000) + 0.5) / 400_000
        whole = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        return float(np.mean((1 - x * s ** (1 / a)) ** (b - 1)) * x**a / a / whole) if x < 1 else 1.0

    for (a, b, x), v in zip(cases, got):
        assert v == pytest.approx(integral(a, b, x), rel=1e-6, abs=1e-12)
    pairs = spark.createDataFrame([(0.0, 10), (0.5, 20), (-0.5, 20), (1.0, 5), (0.9, 2), (None, 9)], "r double, n long")
    p = [r.p for r in pairs.select(W.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert p[0] == pytest.approx(1.0) and p[1] == pytest.approx(0.024769, abs=1e-5) and p[1] == p[2]
    assert p[3] == 0.0 and p[4] is None and p[5] is None


def fit_data(spark, n=500, d=4):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    x[:, 3] += x[:, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(1 + x[:, 0] - x[:, 1]))).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in a], int(v)) for i, (a, v) in enumerate(zip(x, y))], "id long, x array<double>, label int")
    return x, y, df


def test_fits_of_a_grid_against_newton(spark):
    """Every fit of the grid equals a fit of its own; class weights enter as repeated rows would."""
    x, y, df = fit_data(spark)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    fits = [G.Fit(1.0), G.Fit(0.01), G.Fit(1.0, balanced=True)]
    models = G.fit_logistic(df.repartition(7), "x", "label", fits)
    for fit, model in zip(fits[:2], models):
        w = newton_logistic(z, y, fit.c)
        got = np.array([r.s for r in df.select("id", model.score("x").alias("s")).orderBy("id").collect()])
        assert np.allclose(got, z @ w[:-1] + w[-1], atol=1e-8)
    # At the balanced optimum the weighted residuals of the constant vanish, and those of the features meet the penalty.
    v = models[2]
    p = 1 / (1 + np.exp(-(x @ v.weights + v.offset)))
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    assert abs((share * (y - p)).sum()) < 1e-6
    assert np.allclose(z.T @ (share * (y - p)), v.weights * x.std(0, ddof=1), atol=1e-6)


def test_fit_edges(spark):
    x, y, df = fit_data(spark, 60)
    spoiled = df.unionByName(spark.createDataFrame([(900, None, 1), (901, [0.0] * 4, None)], df.schema))
    (a,), (b,) = (G.fit_logistic(t, "x", "label") for t in (df, spoiled))
    assert np.allclose(a.weights, b.weights, atol=1e-8)
    # A constant feature has no weight, also among equal rows.
    flat = df.withColumn("x", F.concat("x", F.array(F.lit(2.0))))
    (c,) = G.fit_logistic(flat, "x", "label")
    assert abs(c.weights[4]) < 1e-9 and np.allclose(c.weights[:4], a.weights, atol=1e-7)
    for empty in (df.limit(0), df.filter("label = 1")):
        with pytest.raises(ValueError, match="labels 0 and 1"):
            G.fit_logistic(empty, "x", "label")


def test_separable_classes_fit_too(spark):
    df = spark.createDataFrame([([float(i)], int(i >= 10)) for i in range(20)], "x array<double>, label int")
    (model,) = G.fit_logistic(df, "x", "label", [G.Fit(1e4)])
    z = (np.arange(20.0) - 9.5) / np.arange(20.0).std(ddof=1)
    w = newton_logistic(z[:, None], (np.arange(20) >= 10).astype(int), 1e4)
    assert np.isclose(model.weights[0] * np.arange(20.0).std(ddof=1), w[0], rtol=1e-5)


def test_kmer_counts_and_fit(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(150)] + ["", None, "AC", "ACNNGTTTT", "acgt", "é" + "A" * 5]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id long, seq string")
    places = {k: i for i, k in enumerate("".join(p) for n in range(1, 4) for p in itertools.product("ACGT", repeat=n))}
    counted = {r.id: list(r.c) for r in df.select("id", G.kmer_counts("seq", 1, 3).alias("c")).collect()}
    for i, s in enumerate(texts):
        want = [0.0] * len(places)
        for n in range(1, 4):
            for j in range(len(s or "") - n + 1):
                if s[j : j + n] in places:
                    want[places[s[j : j + n]]] += 1
        assert counted[i] == want, s
    data = df.filter("id < 150").withColumn("label", (F.instr("seq", "GAT") > 0).cast("int")).withColumn("gc", (F.col("id") * 37 % 11) / 11.0)
    got = [r.score for r in N.kmer_logistic(data, "label", ["gc"])(data).orderBy("id").collect()]
    full = [(list(r.c), r.gc, r.label) for r in data.orderBy("id").select(G.kmer_counts("seq", 1, 4).alias("c"), "gc", "label").collect()]
    gc = np.array([g for _, g, _ in full])
    x = np.column_stack([np.array([c for c, _, _ in full]), (gc - gc.mean()) / gc.std(ddof=1)])
    w = newton_logistic(x, np.array([v for _, _, v in full]), 1.0)
    assert np.allclose(got, x @ w[:-1] + w[-1], atol=1e-6)


def test_counted_texts_fit_like_stored_counts(spark):
    """Counts made in each pass, over several blocks of rows, give the fit of counts that are stored."""
    rng = random.Random(17)
    texts = ["".join(rng.choice("ACGTN") for _ in range(25)) for _ in range(G.BLOCK + 300)]
    df = spark.createDataFrame([(i, s, [float(i % 7)], int(rng.random() < 0.3 + 0.4 * ("GA" in s))) for i, s in enumerate(texts)], "id long, seq string, x array<double>, label int")
    (model,) = G.fit_logistic(df.coalesce(1), "x", "label", counted=("seq", 1, 2))
    got = np.array([r.s for r in df.coalesce(1).select("id", model.score("x", "seq").alias("s")).orderBy("id").collect()])
    full = df.select("id", G.kmer_counts("seq", 1, 2).alias("c"), "x", "label").orderBy("id").collect()
    number = np.array([r.x[0] for r in full])
    x = np.column_stack([np.array([list(r.c) for r in full]), (number - number.mean()) / number.std(ddof=1)])
    w = newton_logistic(x, np.array([r.label for r in full]), 1.0)
    assert np.allclose(got, x @ w[:-1] + w[-1], atol=1e-6)


def test_ranker_features_are_made_in_tasks(spark):
    """TF-IDF by brute force, and no closure of a fitted model in the plan that scores."""
    texts = ["ACGTAC", "ACGACG", "TTTT", "AC", None, "ACGNACG"]
    df = spark.createDataFrame([(i, s, float(i)) for i, s in enumerate(texts)], "id long, seq string, gc double")
    kit = N._kmer_numbers(df, F.array("gc"), "seq", 2, 3)
    places = {k: i for i, k in enumerate("".join(p) for n in (2, 3) for p in itertools.product("ACGT", repeat=n))}
    counts = np.zeros((len(texts), len(places)))
    for i, s in enumerate(texts):
        for n in (2, 3):
            for j in range(len(s or "") - n + 1):
                if s[j : j + n] in places:
                    counts[i, places[s[j : j + n]]] += 1
    seen = (counts > 0).sum(axis=0)
    v = np.where((counts > 0) & (seen >= 2), (1 + np.log(np.maximum(counts, 1))) * (np.log(7 / (seen + 1)) + 1), 0)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    want = np.column_stack([v / np.where(norm > 0, norm, 1), (np.arange(6) - 2.5) / np.arange(6).std(ddof=1)])
    assert np.allclose(kit.matrix(texts, [[float(i)] for i in range(6)]), want)
    pairs = spark.createDataFrame([(0, 2), (1, 2), (5, 3)], "positive_id long, negative_id long")
    score, weights = N.pairwise_ranker(df, pairs, "id", ["gc"], low=2, high=3)
    scored = score(df)
    assert "UDF(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose([r.score for r in scored.orderBy("id").collect()], want @ weights)


def test_near_windows_are_a_star(spark):
    """A long row of near sites links each site to the smallest one, not to its neighbour; a NULL place links nothing."""
    schema = "site_key long, genes array<string>, seq string, chrom string, position long, strand string"
    near = [(200 - i, None, f"s{i}", "chr1", 1000 + 100 * i, "+") for i in range(150)]
    far = [(300, None, "t0", "chr1", 1000 + 100 * 149 + 101, "+"), (301, None, "t1", "chr1", 5050, "-"), (302, None, "t2", "chr1", 5150, "-")]
    none = [(400, None, "u0", None, 1000, "+"), (401, None, "u1", "chr2", None, "+"), (402, None, "u2", "chr2", 70, None), (403, None, "u3", "chr2", 170, None)]
    df = spark.createDataFrame(near + far + none, schema)
    edges = rows(K.leakage_edges(df).distinct(), "a", "b")
    assert edges == sorted([(i, 51) for i in range(52, 201)] + [(302, 301), (403, 402)])
    sizes = dict(rows(K.leakage_components(df), "component", "group_size"))
    assert sizes == {51: 150, 300: 1, 301: 2, 400: 1, 401: 1, 402: 2}


def test_labels_without_the_exact_test(spark):
    """Without the test all other columns are the same, and no Python runs."""
    n = 40
    counts = spark.range(n * 6).selectExpr(
        "id div 6 AS site_id", "id % 6 AS sample", "CASE WHEN id % 6 < 3 THEN 'treated' ELSE 'control' END AS grp",
        "20 + id * 7 % 30 AS depth", "CASE WHEN id % 6 < 3 THEN id % 5 ELSE 0 END AS alt", "CAST(0 AS BIGINT) AS other",
    ).withColumn("ref", F.col("depth") - F.col("alt"))
    sites = spark.range(n).selectExpr("id AS site_id", "'chr1' AS chrom", "id div 2 * 3 AS position", "repeat('ACGTTGCA', 12) || 'ACGTC' AS seq")
    variants = sites.filter("site_id % 5 = 0").select("chrom", "position")
    samples = [(i, "treated" if i < 3 else "control") for i in range(6)]
    made = lambda test: flows.label_sites(sites, counts, samples, variants, F.col("site_id") % 3 > 0, ["chrom", "position"], test=test)
    full, plain = made(True), made(False)
    assert set(full.columns) - set(plain.columns) == {"fisher_p", "fdr", "positive_high_confidence"}
    assert rows(full, *plain.columns) == rows(plain, *plain.columns)
    assert "Python" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs_against_brute_force(spark):
    """Weights and loss of every pair listed; each row counts, however few positives there are."""
    rng = random.Random(21)
    data = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice((0, 2, 9, 30)))) + ("GAT" if i % 5 == 0 else ""), int(i % 5 == 0), rng.random()) for i in range(120)]
    data += [(200, None, 0, 0.5), (201, "ACGNNACG" + "A" * 300, 1, 0.1), (202, "ACG", None, 0.1), (203, "ACG", 0, None)]
    df = spark.createDataFrame(data, "id long, seq string, label int, gc double").repartition(5)
    _, weights = N.all_pairs_ranker(df, "label", ["gc"], low=2, high=3)
    used = [d for d in data if d[2] is not None and d[3] is not None]
    rows_ = spark.createDataFrame(used, df.schema).coalesce(1)
    kit = N._kmer_numbers(rows_, F.array("gc"), "seq", 2, 3)
    x = kit.matrix([d[1] for d in used], [[d[3]] for d in used])
    y = np.array([d[2] for d in used])
    pairs = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    heavy = max(y.sum(), (1 - y).sum())
    loss = lambda w: np.logaddexp(0, -pairs @ w).mean() + w @ w / (4 * heavy)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(pairs @ w))
        bend = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + np.eye(len(w)) / (2 * heavy)
        w = w - np.linalg.solve(bend, -pairs.T @ p / len(pairs) + w / (2 * heavy))
    assert loss(w) <= loss(weights) < loss(w) + 1e-3 < loss(np.zeros(len(w))) - 0.1
    assert np.corrcoef(x @ weights, x @ w)[0, 1] > 0.99


def test_slopes_of_all_pairs():
    rng = np.random.default_rng(22)
    scores = {1: rng.normal(1, 3, 40), 0: rng.normal(0, 30, 70)}
    masses = {0: defaultdict(float), 1: defaultdict(float)}
    for c, s in scores.items():
        for first, share in zip(*Q.on_grid(s)):
            for j, part in enumerate(share):
                masses[c][int(first) + j] += part
    found = Q.slopes(masses)
    apart = scores[0][None] - scores[1][:, None]
    turn = 1 / (1 + np.exp(-apart))
    assert found.loss == pytest.approx(np.logaddexp(0, apart).sum(), rel=1e-10)
    assert np.allclose(found.at(scores[1], np.ones(40, int)), -turn.sum(axis=1), atol=1e-8)
    assert np.allclose(found.at(scores[0], np.zeros(70, int)), turn.sum(axis=0), atol=1e-8)


def test_stored_kmers_are_those_of_the_texts():
    rng = random.Random(23)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.choice((0, 3, 101)))) for _ in range(30)] + [None, "A" * 900, "NNN", "TTTTTT", "AAAAAATTTTTT"]
    idf = np.array([0.0 if i % 11 == 0 else 1 + i / 5000 for i in range(5440)])
    kit = N.KmerNumbers(3, 6, idf, np.array([0.5]), np.array([2.0]))
    x = [[i / 7] for i in range(len(texts))]
    part = pa.RecordBatch.from_pydict({"y": pa.array([i % 2 for i in range(len(texts))], pa.int32()), "text": texts, "x": x})
    features = N.StoredKmers(kit)
    (stored,) = features.store([part])
    want = kit.matrix(texts, x)
    w, by = np.random.default_rng(1).normal(size=(2, features.size)), np.linspace(-1, 1, len(texts))
    for rows_, piece in ((slice(0, None), stored), (slice(9, 33), stored.slice(9, 24))):
        assert np.allclose(features.scores(piece, *w), (want[rows_] @ w.T).T)
        assert np.allclose(features.sums(piece, by[rows_]), by[rows_] @ want[rows_])
        assert np.allclose(features.sums(piece, by[rows_], True), by[rows_] @ want[rows_] ** 2)


def test_the_pairwise_query_draws_nothing(spark, monkeypatch):
    """l2 fits on every row of its training part."""
    from sitelab.plans import catalog
    from sitelab.plans.registry import REGISTRY

    catalog.load()
    seen = []
    fit = N.fit_all_pairs
    monkeypatch.setattr(N, "fit_all_pairs", lambda data, *a, **k: seen.append(data.groupBy("y").count().collect()) or fit(data, *a, **k))
    REGISTRY["l2_pairwise_kmer_ranker"].run(spark, "/root/testdata/sf0.01").collect()
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    assert sum(r["count"] for r in seen[0]) == orders.filter("o_orderkey % 10 < 7").count() > 2 * 2000
