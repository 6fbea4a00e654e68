"""Operators on whole tables: near duplicates, Jaccard join, lines, mixing, archives, and the pipeline."""

import io
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import DOCUMENT, SENTENCE, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from sitelab.llm import jaccard_join, line_spread, mixing, near_dedup, pieces, registry, warc
from sitelab.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Near duplicates among vectors


def test_bound_covers_the_error():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 64, 300):
        x = rng.normal(size=(50, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        q, s, e, near = near_dedup.quantised(x)
        assert np.abs(q).max() <= 127
        product = (q @ q.T).astype(float) * s[:, None] * s[None, :]
        bound = e[:, None] + near[:, None] * e[None, :] + near_dedup.MARGIN
        assert np.all(np.abs(product - x @ x.T) <= bound)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.2])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if i % 17 else None))
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [1.0, None], 0), (304, [1.0, 2.0], 0)]
    rows += [(305, [], 1), (None, rows[0][1], 0), (306, [3e38] * 16, 0), (307, [float("inf")] + [0.0] * 15, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    sound = {
        i: np.array(e, dtype=float)
        for i, e, label in rows
        if i is not None and label is not None and e and None not in e and np.isfinite(e).all() and np.any(np.array(e) != 0)
    }
    label = {i: x for i, _, x in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(sound), 2)
        if label[a] == label[b] and len(sound[a]) == len(sound[b])
        and sound[a] @ sound[b] / (np.linalg.norm(sound[a]) * np.linalg.norm(sound[b])) >= 0.98
    ]
    n = Counter(x for pair in links for x in pair)
    root = components([i for i, _, _ in rows if i is not None], links)
    for tile in (2048, 16):
        found = near_dedup.near_duplicates(vectors.withColumn("rep", F.lit("own")), tile=tile).collect()
        assert len(found) == len(rows)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
        assert got.pop(None) == (0, None, False)
        assert got == {i: (n[i], root[i], root[i] == i) for i in root}
    assert links


def test_near_duplicates_of_doubles_are_not_rounded(spark):
    """Pairs within 1e-12 of the threshold, given in double precision, link as the exact cosine says."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for i in range(40):
        x, z = rng.normal(size=(2, 16))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        angle = np.arccos(0.98 + (1e-12 if i % 2 else -1e-12))
        y = np.cos(angle) * x + np.sin(angle) * z / np.linalg.norm(z)
        rows += [(2 * i, x.tolist(), i), (2 * i + 1, y.tolist(), i)]
        want[2 * i] = want[2 * i + 1] = i % 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in near_dedup.near_duplicates(frame).collect()} == want


def test_near_duplicates_repeated_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    same = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], schema)
    assert sorted(rows_of(near_dedup.near_duplicates(same))) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


# Jaccard join


def brute_jaccard(rows, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = components(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def near_copies(seed, groups=6, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 20, 60, 120]))] + (passage if g % 2 else [])
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(words).title() if rng.random() < 0.3 else "\n".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "W1"), (1004, "w1"), (1005, "w1 w2"), (1006, " ")]
    return rows


@pytest.mark.parametrize(("k", "percent", "small", "tile"), [(3, 90, 16, 256), (5, 80, 3, 256), (3, 60, 0, 4), (3, 70, 1000, 1)])
def test_jaccard_against_brute_force(spark, k, percent, small, tile):
    rows = near_copies(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own")).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent, small, tile).collect()}
    assert got == brute_jaccard(rows, k, percent)


def test_jaccard_edges(edges, no_documents, clashing):
    found = jaccard_join.jaccard_components(edges)
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == edges.count()
    assert got[2].component_id == 1 and got[3].n_shingles == 0 and got[3].component_id == 3
    assert got[None].component_id is None
    assert jaccard_join.jaccard_components(no_documents).count() == 0
    kept = jaccard_join.one_of_each_text(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 8, 9]
    assert kept.filter("doc_id IS NULL").count() == 2
    assert {r._size for r in kept.collect()} == {"own _size"}


def test_filters_let_all_members_pass():
    h = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 20_000)
    bits = np.zeros((1 << jaccard_join.FILTER_BITS) // 8, dtype=np.uint8)
    for table in jaccard_join._packed_bits(iter([pa.RecordBatch.from_pydict({"s": h[:9000]}), pa.RecordBatch.from_pydict({"s": h[9000:10_000]})])):
        joined = jaccard_join._joined_bits(pa.Table.from_batches([table]))
        bits |= np.frombuffer(zlib.decompress(joined.column("bits")[0].as_py()), dtype=np.uint8)
    passed = jaccard_join._passes(h, bits)
    assert passed[:10_000].all() and passed[10_000:].mean() < 0.01


def test_near_copies_go_by_text(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    rows = [
        (1, text["b"]), (8, text["b"]), (8, text["c"]),  # the smaller text is a copy of another document
        (9, text["d"]), (9, text["e"]), (9, text["e"]),  # two unrelated texts under one id, one of them twice
        (None, text["f"]), (None, text["f"] + " more"), (None, text["g"]), (None, text["a"]), (3, text["a"]),
        (None, None), (4, ""), (5, ""),
    ]
    docs = spark.createDataFrame([(i, t, None, "a", None) for i, t in rows], DOCUMENT).repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    got = Counter((r.doc_id, (r.text or "").removesuffix(" more")) for r in kept.collect())
    assert got == Counter([
        (1, text["b"]), (8, text["c"]), (9, text["d"]), (9, text["e"]), (None, text["f"]), (None, text["g"]), (3, text["a"]),
        (None, ""), (4, ""), (5, ""),
    ])


def test_large_overlaps_are_compared_as_whole_numbers():
    percent = 77
    # A set within a larger one, just below the threshold, where a single-precision product would be rounded up to it.
    o = next(o for o in itertools.count(700_001) if 0 < -100 * o % percent < 4 and float(np.float32(o * 100)) - o * 100 == 4)
    union = -(-100 * o // percent)
    sizes, side = np.array([o, union]), (np.array([0]), np.array([1]))
    parts = [{0: np.arange(o)}, {0: np.arange(union)}]
    assert [len(x) for x in jaccard_join.tile_links(parts, sizes, ["a", "b"], *side, percent)] == [0, 0]
    parts[1], sizes[1] = {0: np.arange(union - 1)}, union - 1
    assert [len(x) for x in jaccard_join.tile_links(parts, sizes, ["a", "b"], *side, percent)] == [1, 1]


def test_fragments_cut_the_order():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1))
    levels = rng.integers(0, 3, 1 << jaccard_join.CELL_BITS).astype(np.uint8)
    counts = np.bincount(levels[jaccard_join._cells(h)], minlength=jaccard_join.LEVELS)
    mass = counts / counts.sum()
    order = jaccard_join.Order(levels, np.cumsum(mass) - mass, mass)
    place = order.fragment(h, 8)
    at = np.lexsort((h, order.of(h)))
    assert np.all(np.diff(place[at]) >= 0)
    assert np.bincount(place, minlength=8).min() > 400


# Lines

WHITE = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for doc, text, source in rows:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            if key := line.strip(WHITE):
                sites[key].add(source)
                first[key] = min(first.get(key, (1e18, 0)), (doc, at))
    out = {}
    for doc, text, _ in rows:
        if text is None:
            out[doc] = (None, 0)
            continue
        kept = [
            line for at, line in enumerate(text.split("\n"))
            if len(sites.get(line.strip(WHITE), ())) < min_sites or first[line.strip(WHITE)] == (doc, at)
        ]
        out[doc] = ("\n".join(kept), len(text.split("\n")) - len(kept))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"this is line number {i}" for i in range(12)] + ["short line", "", "  this is line number 3 ", "a b c d", "x", "\tx \r", " \t", "漢字"]
    rows = [
        (i, None if i % 19 == 0 else "\n".join(rng.choice(pool[: rng.choice([3, 20])]) for _ in range(rng.randint(0, 12))), rng.choice(["a", "b", "c", "d", "e", None]))
        for i in range(90)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites in (2, 5, 6):
        got = {r.doc_id: (r.text, r.removed) for r in line_spread.dedup_lines(docs, min_sites=sites).collect()}
        assert got == brute_lines(rows, sites)


def test_estimates_decide_only_far_from_the_threshold(spark):
    rows = [(i, "one two three four five", f"s{i}") for i in range(300)] + [(1000 + i, "six seven eight nine ten", f"s{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc: r for r in line_spread.boilerplate(docs).collect()}
    assert found[1000].exact and found[1000].sites == 5
    assert not found[0].exact and abs(found[0].sites - 300) < 30


def test_lines_edges(edges, no_documents, clashing):
    for docs in (edges, no_documents, clashing):
        cleaned = line_spread.cleaned_documents(docs, min_sites=2)
        assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    got = {r.doc_id: r for r in line_spread.cleaned_documents(edges, min_sites=2).collect()}
    assert got[1].text == SENTENCE and got[2].text == "" and got[2].n_chars == 0 and got[3].text is None


def test_short_lines_of_many_sites_go(spark):
    """One short line of twenty sites, ended in several ways, stays in one document only."""
    ends = ["", "\r", " ", "\t"]
    rows = [(i, f"own text {i}\nAll rights reserved.{ends[i % 4]}\n無断転載禁止", f"s{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.removed) for r in line_spread.dedup_lines(docs).collect()}
    assert got[0] == (rows[0][1], 0) and all(got[i] == (f"own text {i}", 2) for i in range(1, 20))


def test_lines_go_by_the_row_and_not_by_its_id(spark):
    common = "a notice that all sites carry"
    rows = [(i, f"{common}\nown text of document {i}", f"s{i}") for i in range(6)]
    rows += [(None, f"one more clean text\n{common}", "a"), (None, "another clean text here\nits own second line is kept", "a")]
    rows += [(9, f"first text under this id\n{common}", "b"), (9, "second text under this id\nits second line is kept too", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((r.text, r.removed) for r in line_spread.dedup_lines(docs).collect())
    expected = [(t if i == 0 else "\n".join(x for x in t.split("\n") if x != common), int(i != 0 and common in t)) for i, t, _ in rows]
    assert got == sorted(expected)
    # The occurrence that stays is one of a row, also where no row has an id.
    none = spark.createDataFrame([(None, f"{common}\n{i}", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    assert sorted(r.removed for r in line_spread.dedup_lines(none).collect()) == [0, 1, 1, 1, 1, 1]


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def mix_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "a", "ä", "Z", None, "hot", "hot", "hot"])
        rows.append((i, " ".join(["w"] * (rng.choice([0, 1, 5, 5, 30, 200]) + rng.randint(0, 3))), source))
    return rows


def test_mix_meets_targets(spark):
    rows = mix_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = brute_targets(sizes)
    found = mixing.mix(docs.repartition(5)).collect()
    assert len(found) == len(rows)
    taken, words = Counter(), {i: len(t.split()) for i, t, _ in rows}
    for r in found:
        assert r.size == words[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * expected[r.source]
        taken[r.source] += r.taken
    for source, target in expected.items():
        assert abs(taken[source] - target) <= max(0.01 * target, 12)
    for source in expected:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) <= 1e-5 * own[0].target
        # Below the cap the logarithm of the rate is proportional to the size: the solution of the dual.
        tilt = [np.log(r.rate) / r.size for r in own if r.size and r.rate < 2]
        assert not tilt or max(tilt) - min(tilt) < 1e-9
    again = mixing.mix(docs.repartition(3)).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in found}


def test_mix_edges(spark, no_documents, clashing):
    for docs in (no_documents, clashing):
        plan = stored(mixing.mix(docs), "test")
        assert plan.count() == docs.count()
        taken = mixing.mixed_documents(docs)
        assert taken.columns == docs.columns
        assert taken.count() == (plan.agg(F.sum("copies")).first()[0] or 0)
    empty = spark.createDataFrame([(1, "", "a", None, None), (2, None, None, None, None)], DOCUMENT)
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]


def test_mix_without_ids_and_with_equal_rows(spark):
    """Rows without an id are ranked by their text, equal rows as often as they stand there; every mix meets its target."""
    rng = random.Random(8)
    rows = [(None, " ".join(rng.choice("abcdefgh") for _ in range(6)), "a", f"x{i}") for i in range(900)]
    rows += [(7, "the same six words every time", "a", f"y{i}") for i in range(600)]
    rows += [(None, None, "b", "z")] * 300 + [(i, "some few words here", "b", "u") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, url string")
    plan = stored(mixing.mix(docs.repartition(5)), "test")
    assert plan.count() == len(rows)
    dealt = [Counter((r.doc_id, r.source, r.size, r.copies) for r in p.collect()) for p in (plan, mixing.mix(docs.repartition(3)))]
    assert dealt[0] == dealt[1]
    assert all(0 <= r.copies <= 2 and (r.size or not r.copies) for r in plan.collect())
    for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 6, r
    taken = Counter((r.doc_id, r.text, r.source, r.url) for r in mixing.mixed_documents(docs.repartition(4)).collect())
    assert sum(taken.values()) == plan.agg(F.sum("copies")).first()[0] and set(taken) <= set(rows) and max(taken.values()) <= 2


# Archives


def archive(records, packed=True):
    return [warc.member(r) if packed else r for r in records]


def some_records(n=6):
    return [warc.record_bytes(i, f"http://x/{i}", f"payload {i} é".encode() * (i + 1), None if i % 3 else i + 1) for i in range(n)]


def read(data):
    found = list(warc.salvage(io.BytesIO(data)))
    records = [x for x in found if isinstance(x, warc.Record)]
    return [warc._page(r.headers["warc-record-id"]) for r in records], [(g.start, g.end) for g in found if isinstance(g, warc.Gap)]


@pytest.mark.parametrize("packed", [True, False])
def test_sound_archives_have_no_gap(packed):
    assert read(b"".join(archive(some_records(), packed))) == (list(range(6)), [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts = archive(some_records(), packed)
    starts = list(itertools.accumulate([0, *map(len, parts)]))
    whole = b"".join(parts)
    for place in range(starts[2], starts[3]):
        damaged = bytearray(whole)
        damaged[place] ^= 0xFF
        ids, gaps = read(bytes(damaged))
        assert ids[:2] + ids[-3:] == [0, 1, 3, 4, 5]
        # Where a flipped byte is not covered by a check the record may stand; otherwise exactly it is quarantined.
        assert gaps == ([] if len(ids) == 6 else [(starts[2], starts[3])])


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_truncated_and_foreign_bytes(packed):
    parts = archive(some_records(), packed)
    whole = b"".join(parts)
    ids, gaps = read(whole[:-5])
    assert ids == [0, 1, 2, 3, 4] and gaps == [(len(whole) - len(parts[-1]), len(whole) - 5)]
    junk = b"WARC/1.1\r\nno header \x1f\x8b\x08 junk" * 3
    ids, gaps = read(parts[0] + junk + b"".join(parts[1:]))
    assert ids == [0, 1, 2, 3, 4, 5] and gaps == [(len(parts[0]), len(parts[0]) + len(junk))]
    ids, gaps = read(junk)
    assert ids == [] and gaps == [(0, len(junk))]


def test_salvage_inside_a_member():
    parts = some_records()
    whole = b"".join(parts)
    packed = warc.member(whole)
    assert read(packed) == (list(range(6)), [])
    # One record fails its own check in a sound member: only it is quarantined.
    bad = parts[2].replace(b"payload 2", b"PAYLOAD 2", 1)
    found = list(warc.salvage(io.BytesIO(warc.member(whole.replace(parts[2], bad)) + warc.member(parts[0]))))
    start = len(parts[0] + parts[1])
    assert [x.reason for x in found if isinstance(x, warc.Gap)] == [f"payload digest differs, bytes {start} to {start + len(bad)} of the member"]
    assert [warc._page(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)] == [0, 1, 3, 4, 5, 0]
    # A member that breaks off gives what lies before the last record in it.
    store = zlib.compressobj(0, zlib.DEFLATED, 31)
    packed = store.compress(whole) + store.flush()
    ids, gaps = read(packed[: len(packed) - len(parts[5]) - 20] + warc.member(parts[0]))
    assert ids == [0, 1, 2, 3, 0] and len(gaps) == 1
    ids, gaps = read(warc.member(whole)[:-40])
    assert ids and ids == list(range(len(ids))) and len(gaps) == 1
    damaged = bytearray(warc.member(whole))
    damaged[-6] ^= 0xFF
    assert read(bytes(damaged))[0] == []


def test_members_and_headers_have_no_size_of_their_own(monkeypatch):
    url = "http://x/" + "u" * 200_000
    for data in (warc.member(r := warc.record_bytes(1, url, b"x", None)), r):
        (found,) = warc.salvage(io.BytesIO(data))
        assert found.headers["warc-target-uri"] == url
    # Many records in one member, together beyond the largest block: a bound of the record, not of the member.
    monkeypatch.setattr(warc, "MOST", 4 << 20)
    rng = random.Random(7)
    parts = [warc.record_bytes(i, None, rng.randbytes(1 << 20), None) for i in range(9)]
    assert read(warc.member(b"".join(parts)) + warc.member(parts[0])) == ([*range(9), 0], [])


def test_window_bounds_memory():
    class Stream(io.RawIOBase):
        def __init__(self):
            self.left = 200

        def read(self, n=-1):
            self.left -= 1
            return b"x" * warc.CHUNK if self.left > 0 else b""

    window = warc._Window(Stream())
    assert window.find(1) is None and len(window.data) <= 2 * warc.CHUNK


def test_wrong_digest_is_quarantined():
    good = some_records(3)
    bad = warc.record_bytes(9, None, b"one payload", None, digest="00" * 20)
    ids, gaps = read(good[1] + bad + good[2])
    assert ids == [1, 2] and gaps == [(len(good[1]), len(good[1]) + len(bad))]


def test_archives_round_trip(spark, tmp_path):
    long = "ü" * 700
    rows = [
        (1, "http://a/\r\nb", long), (2, None, long), (3, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
        (7, "u", ""), (None, "u", long), (3, "u", long), (8, "u", "x" * 3_000_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    folder = f"{tmp_path}/warc"
    manifest = warc.write_archives(pages, folder, file_bytes=1000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    found = warc.read_archives(manifest).collect()
    assert all(r.gap is None for r in found)
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in found)
    assert got == [
        (0, "revisit", 3, 1400), (1, "revisit", 3, 1400), (2, "revisit", 3, 1400), (3, "response", None, 1400), (3, "response", None, 1400),
        (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 3_000_000),
    ]
    assert {r.payload for r in found if r.page_id == 3} == {long.encode()}
    assert len({r.payload_digest for r in found if r.payload_bytes == 1400}) == 1
    assert next(r.url for r in found if r.page_id == 1) == "http://a/%0D%0Ab"
    # A damaged file on disk loses only its damaged record.
    path = manifest.orderBy(F.desc("records")).first()["path"]
    with open(path, "r+b") as file:
        data = bytearray(file.read())
        data[len(zlib.decompressobj(31).decompress(bytes(data))) % 20 + 30] ^= 0xFF
        file.seek(0)
        file.write(data)
    again = warc.read_archives(manifest).collect()
    assert sum(r.gap is not None for r in again) == 1 and sum(r.gap is None for r in again) == len(rows) - 1


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"{tmp_path}/none")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


# Pipeline


def test_queries_are_registered():
    registry.load()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


def test_stages_keep_columns(spark, no_documents, clashing):
    for docs in (no_documents, clashing):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = stored(stage(spark, kept, "/root/testdata/sf0.001"), "test")
            assert kept.columns[: len(docs.columns)] == docs.columns or "SentencePiece" in name
        assert {"ids", "n_ids", "round_trip"} <= set(kept.columns)


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input, by plainer means; the quality scores are taken as they are."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf), "test"))
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i in texts[0] if labels.get(i) == 1]
    assert sum(i in texts[1] for i in good) >= 0.98 * len(good)
    assert all(texts[1][i] == texts[0][i] for i in texts[1])
    source = {r.doc_id: r.source for r in docs.collect()}
    lines = brute_lines([(i, t, source[i]) for i, t in texts[1].items()], line_spread.MIN_SITES)
    assert texts[2] == {i: t for i, (t, _) in lines.items()}
    copies = brute_jaccard(list(texts[2].items()), 5, 80)
    assert texts[3] == {i: texts[2][i] for i, (_, root) in copies.items() if root == i}
    sizes, taken = Counter(), Counter()
    for i, t in texts[3].items():
        sizes[source[i]] += len(WORD.findall(t))
    times = Counter(r.doc_id for r in frames[4].collect())
    for i, n in times.items():
        assert n <= 2 and texts[4][i] == texts[3][i]
        taken[source[i]] += n * len(WORD.findall(texts[3][i]))
    for name, target in brute_targets(sizes).items():
        smallest = min(len(WORD.findall(t)) for i, t in texts[3].items() if source[i] == name)
        assert abs(taken[name] - target) <= max(0.02 * target, smallest)
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    for r in frames[5].collect():
        assert r.round_trip and r.ids == pieces.encode(r.text, vocabulary) and r.n_ids == len(r.ids)
    assert frames[5].count() == frames[4].count()


def test_mixed_texts_are_shuffled_once(spark):
    """The join with the plan and the numbers of equal rows share one placement of the rows; equal rows differ by one copy at most."""
    data = [(i, f"a b c {i}", "s" if i % 3 else None) for i in range(30)] + [(None, "x y", "s")] * 3 + [(7, "same same", "t")] * 5
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taken = mixing.mixed_documents(docs)
        plan = taken._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(_who", plan)) == 1
        got = Counter((r.doc_id, r.text, r.source) for r in taken.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = Counter()
    for r in mixing.mix(docs).join(docs.distinct(), "doc_id").filter("doc_id <> 7").collect():
        want[r.doc_id] += r.copies
    assert {d: c for (d, _, _), c in got.items() if d not in (None, 7)} == {d: c for d, c in want.items() if c}
