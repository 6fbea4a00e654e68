"""Cross-tokenizer alignment, license rules and hard negatives against plain versions."""

import bisect
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import rows_of
from pyspark.sql import functions as F

from sitelab.llm import hard_negatives, license_scan, token_alignment
from sitelab.llm.license_rules import BASE, all_rules
from sitelab.llm.token_alignment import PerfectHash, Tokenizers

# Alignment


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.default_tokenizers()


def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(text, first, second):
    """(a ids, b ids, groups, links), found token by token; None for a text without tokens."""
    if not text:
        return None
    whole, byte_of = b" " + text.encode(), token_alignment._byte_of()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    a_bytes = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
    pieces = [second.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    ends_a, ends_b = (np.cumsum([0, *map(len, x)]).tolist() for x in (a_bytes, b_bytes))
    links = []
    for i in range(len(a)):
        j = bisect.bisect_right(ends_b, ends_a[i]) - 1
        while j < len(b) and ends_b[j] < ends_a[i + 1]:
            links.append((a[i], b[j]))
            j += 1
    groups, at_a, at_b = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b))[1:]:
        to_a, to_b = ends_a.index(end), ends_b.index(end)
        groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
        at_a, at_b = to_a, to_b
    return a, b, groups, links


def texts_to_align():
    rng = random.Random(5)
    chars = "abc the ing 12 \n\t'.,!éß漢字🙂 "
    made = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    fixed = [None, "", " ", "a ▁ b", "x<|endoftext|>y </s> <s> <0x41> \x00 z", " lead", "  two", "words words words", "x" + " " * 2500 + "y", "　" * 2100]
    return [*fixed, *made, *made[:30]]


@pytest.mark.parametrize("shard, block", [(1 << 18, 16), (40, 3)])
def test_alignment_against_brute_force(spark, tokenizers, shard, block):
    first, second = libraries()
    texts = texts_to_align()
    plain = [plain_alignment(t, first, second) for t in texts]
    counts = Counter(link for p in plain if p for link in p[3])
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    expected = []
    for i, p in enumerate(plain):
        if p is None:
            expected.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = p
        best = sum(counts[link] == most[link[1]] for link in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        expected.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[link] for link in links), digest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(rows_of(token_alignment.aligned(docs, tokenizers, shard, block))) == expected
    assert sum(p is None for p in plain) == 3


def test_alignment_edges(edges, no_documents, clashing, tokenizers):
    got = rows_of(token_alignment.aligned(edges, tokenizers))
    assert len(got) == edges.count()
    assert Counter(r[0] for r in got)[2] == 2 and len({r for r in got if r[0] == 2}) == 1
    assert sorted(map(str, got)) == sorted(map(str, rows_of(token_alignment.aligned(clashing, tokenizers))))
    assert rows_of(token_alignment.aligned(no_documents, tokenizers)) == []


def test_perfect_hash_is_minimal_and_keys_are_verified():
    keys = np.random.default_rng(1).choice(1 << 31, 50_000, replace=False)
    made = PerfectHash.build(keys)
    assert sorted(made.index(keys)) == list(range(len(keys)))
    again = PerfectHash.unpacked(*made.packed())
    assert (again.index(keys) == made.index(keys)).all()
    ordered = np.empty_like(keys)
    ordered[made.index(keys)] = keys
    shards = 3
    mine = ordered[token_alignment._shard(ordered, shards) == 1]
    found = PerfectHash.build(mine)
    kept = np.empty_like(mine)
    kept[found.index(mine)] = mine
    foreign = np.setdiff1d(np.arange(10_000), keys)
    n = token_alignment._lookup({1: (found, kept, np.full(len(kept), 7))}, np.concatenate((mine, foreign)), shards)
    assert (n[: len(mine)] == 7).all() and not n[len(mine) :].any()
    assert PerfectHash.build(np.empty(0, dtype=np.int64)).index(keys[:3]).tolist() == [-1] * 3


def test_byte_level_entries_cover_all_bytes(tokenizers: Tokenizers):
    assert {bytes([b]) for b in range(256)} <= set(tokenizers.ranks)


# License rules


def plain_scan(text):
    """(n_words, n_base, first, last, base labels) word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = []
    for phrase, label in BASE.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def license_texts():
    rng = random.Random(8)
    parts = [
        "under the MIT license", "Apache License, Version 2.0", "CC-BY-NC 4.0", "cc by", "nc", "under the", "mit", "İ", "é漢", "\x00", "version", "2",
        "This is licensed under the GNU Lesser General Public License, version 2.1", "All rights reserved.", "\n", "license", "@", "GPLv2", "x" * 50,
    ]
    return [None, "", "...", *(rng.choice([" ", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300))]


def test_base_phrases_against_brute_force(spark):
    texts = license_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = license_scan.license_scan(docs).orderBy("doc_id").select("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(got) == [plain_scan(t) for t in texts]


def test_prefilter_and_suppression_against_all_rules_and_pairs():
    rules = license_scan.default_rules()
    assert len(rules.rules) > 300 and len({(r.label, r.pattern.pattern, r.rank) for r in rules.rules}) > 300
    for text in license_scan.normalised(pa.array(license_texts())).to_pylist():
        plain = [
            license_scan.Detection(i, m.start() + 1, m.end())
            for i, r in enumerate(rules.rules)
            if all(k in text for k in r.keywords)
            for m in r.pattern.finditer(text)
            if r.holds in m.group()
        ]
        found = license_scan.detections(text, rules)
        assert sorted(found, key=str) == sorted(plain, key=str)
        rank = lambda d: rules.rules[d.rule].rank

        def silences(x, d):
            if (x.start, x.end) == (d.start, d.end):
                return (rank(x), x.rule) < (rank(d), d.rule)
            return rank(x) <= rank(d) and x.start <= d.start and x.end >= d.end

        stay = [d for d in plain if not any(silences(x, d) for x in plain if x is not d)]
        assert sorted(license_scan.kept(found, rules), key=str) == sorted(stay, key=str)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"),
        ("This program is licensed under the GNU Lesser General Public License, version 2.1 or later.", "lgpl-2.1"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa"),
        ("see https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Mozilla Public License 2.0", "mpl-2"),
        ("All rights reserved.", "all-rights-reserved"),
        ("A vim session with python on the eclipse, under the sun; no license was needed to submit it.", ""),
        ("the apache helicopter and the ruby", ""),
    ],
)
def test_licenses_are_told_apart(text, labels):
    found = license_scan.scan(license_scan.normalised(pa.array([text]))[0].as_py(), license_scan.default_rules())
    assert found[4] == labels
    assert (found[5] > 0) == bool(labels)


def test_license_edges(edges, no_documents, clashing):
    got = rows_of(license_scan.license_scan(edges))
    assert len(got) == edges.count() and all(0 <= r[7] <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, rows_of(license_scan.license_scan(clashing))))
    assert rows_of(license_scan.license_scan(no_documents)) == []


def test_every_rule_holds_its_keywords():
    """A keyword that a pattern cannot hold would silence the rule; sentences are tried as they stand."""
    for rule in all_rules():
        assert all(re.fullmatch("[a-z0-9 ]+", k) for k in rule.keywords), rule


# Hard negatives


def plain_negatives(rows, every=100, low=30, high=90):
    """By whole numbers of any size; ``rows`` is (vec_id, embedding, label)."""
    sound = [
        (i, [int(np.floor(256 * float(x))) for x in e], label)
        for i, e, label in rows
        if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    out = []
    for at, (anchor, qa, label) in enumerate(sound):
        if anchor % every:
            continue
        met = [(sum(x * y for x, y in zip(qa, q, strict=True)), i, other) for k, (i, q, other) in enumerate(sound) if k != at and len(q) == len(qa)]
        met.sort(key=lambda m: (-m[0], m[1]))
        for score, positive, _ in [m for m in met if m[2] == label][:5]:
            inside = [m for m in met if m[2] != label and low * score <= 100 * m[0] <= high * score][:10]
            out += [(anchor, positive, n + 1, m[1], score, m[0]) for n, m in enumerate(inside)]
    return sorted(out)


def vectors(seed, n, spread=1.0, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    label = rng.integers(0, 4, n)
    points = (centres[label] + rng.normal(size=(n, dim)) * rng.choice([0.2, 1.0], n)[:, None]) * spread
    return [(int(i), [float(x) for x in p], int(c)) for i, p, c in zip(range(n), points, label, strict=True)]


@pytest.mark.parametrize("rows, block", [(vectors(1, 400), 1 << 20), (vectors(2, 250, 40.0, 3), 16), (vectors(3, 120, 1e6), 1 << 20)])
def test_negatives_against_brute_force(spark, rows, block):
    ties = [(10_000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    rows = rows + ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = hard_negatives.mine(hard_negatives.sound_rows(frame), every=25, block=block)
    assert sorted(rows_of(got)) == plain_negatives(rows, 25)


def test_scores_beyond_64_bits_are_an_error():
    big, other = np.full((1, 4), 2.0**40), np.array([[2.0**40, -(2.0**40), 3.0, 0.0]])
    assert hard_negatives.scores(big, other).tolist() == [[3 << 40]]
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.scores(big, big)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(5, 60) + [
        (100, None, 1), (200, [1.0] * 8, None), (None, [1.0] * 8, 1), (300, [nan] * 8, 1), (301, [inf] * 8, 1), (302, [None] + [1.0] * 7, 1),
        (400, [0.0] * 8, 1), (500, [], 1), (501, [], 1), (502, [], 2), (600, [1.0, 2.0], 1), (601, [1.0, 1.0], 1), (602, [0.5, 0.5], 2),
        (700, [1.0] * 8, 2), (700, [1.0] * 8, 2), (-100, [0.5] * 8, 3),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    extra = frame.withColumn("q", F.lit("own")).withColumn("uid", F.lit(1)).withColumn("number", F.lit(None).cast("string"))
    got = sorted(rows_of(hard_negatives.mine(hard_negatives.sound_rows(extra))))
    assert got == plain_negatives(rows)
    assert {r[0] for r in got} >= {-100, 600, 700}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert rows_of(hard_negatives.mine(hard_negatives.sound_rows(none))) == []


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(7)
    q = np.floor(rng.normal(size=(300, 6)) * rng.choice([0.01, 300], (300, 1)))
    q[:100] = np.floor(q[0] + rng.normal(size=(100, 6)) * 3)
    refs = hard_negatives.references(q[:200])
    norm, theta = hard_negatives.angles(q, refs)
    low, high = hard_negatives.score_bounds(norm[:50], theta[:50], norm, theta)
    exact = q[:50] @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < norm[:50, None] * norm[None, :] * 0.9).mean() > 0.2
    for at in range(0, 300, 40):
        part = slice(at, at + 40)
        assert (hard_negatives.tile_highest(norm[:50], theta[:50], norm[part], theta[part]) >= exact[:, part].max(axis=1)).all()
