"""Cross-tokenizer alignment with corpus-wide counts of linked id pairs.

Two tokenizers cut the same bytes. Where both end a token, a group ends; an A token and a
B token whose byte ranges overlap are a link. Every stretch between two neighbouring ends
of either side belongs to exactly one link, so links follow from the marked ends of a
whole block of texts at once.

How often an id pair is linked in the corpus is counted by minimal perfect hashing:

1. The first pass aligns all texts; each task writes its pairs with their counts.
2. The distinct pairs are dealt by hash into shards, and a task builds for each shard a
   minimal perfect hash: levels of bits, a key's place being the first level where it
   stood alone, and its index the rank of that bit. The keys are kept by index.
3. Tasks turn their counts into dense vectors over that index, which are summed as a tree.
4. The second pass aligns the texts again and looks every link up: index by the hash, key
   compared with the kept one, count from the vector.

At most ``BLOCK_SHARDS`` shards of about ``SHARD`` pairs are sent to the tasks at once, a
proven bound of ``BLOCK_SHARDS * SHARD`` keys and counts; a larger table is looked up in
several rounds of the second pass, and the sums of a row add up. Both tokenizers go to the
tasks as data, bounded by their vocabularies.

A text that is NULL, empty, or not given back byte for byte by the tokens of either side
has no tokens: all numbers are 0 and the digest is ''. Special tokens' strings are plain
text. Rows are judged one by one, so NULL or repeated ids and repeated rows give a row each
(repeated texts count as often as they occur). A long text is aligned as a whole; memory
is a small multiple of it. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import checked_columns, mixed, stored, table, text_slices
from sitelab.llm.registry import query

#: Pairs of a shard on average, and shards that are sent to the tasks at once.
SHARD = 1 << 18
BLOCK_SHARDS = 16
#: Distinct pairs that a task of the first pass holds before it writes them.
HELD = 1 << 21
#: Bits of a level for each key that is left.
ROOM = 2.0
#: Fixed value: how the byte-level tokenizer cuts a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space runs of this length are cut out of a text by rule: the pattern library runs out of stack on them.
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2000,}")

_READY: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _first_ids(first, unit, text: str) -> list[int]:
    """A ids. A run of white space is one unit but for a last character before other text, which starts the next unit."""
    if len(text) < 2000:
        return first.encode_ordinary(text)
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += first.encode_ordinary(text[at : run.start()])
        ids += unit.encode_ordinary(text[run.start() : end])
        at = end
    return ids + first.encode_ordinary(text[at:])


@dataclass
class Tokenizers:
    """Both vocabularies as plain data; the encoders are built once a worker."""

    ranks: dict[bytes, int]
    model: bytes
    digest: str
    bytes_a: pa.Array = field(repr=False)
    bytes_b: pa.Array = field(repr=False)

    @staticmethod
    def load(path_a: str, path_b: str) -> Tokenizers:
        import sentencepiece

        with open(path_a, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        with open(path_b, "rb") as file:
            model = file.read()
        byte_of = _byte_of()
        ranks = {bytes(map(byte_of.__getitem__, entry)): i for entry, i in entries.items() if all(c in byte_of for c in entry)}
        # Entries that stand for no bytes (special ones) are never met in a text.
        size = max(entries.values()) + 1
        texts_a: list[bytes] = [b""] * size
        for data, i in ranks.items():
            texts_a[i] = data
        special = {e["id"] for e in json.load(open(path_a, encoding="utf-8")).get("added_tokens", [])}
        ranks = {data: i for data, i in ranks.items() if i not in special}
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts_b = []
        for i in range(pieces.get_piece_size()):
            piece = pieces.id_to_piece(i)
            if pieces.is_byte(i):
                texts_b.append(bytes([int(piece[3:5], 16)]))
            else:
                texts_b.append(b"" if pieces.is_control(i) or pieces.is_unknown(i) else piece.replace("▁", " ").encode())
        digest = hashlib.sha256(model + repr(sorted(ranks.items())).encode()).hexdigest()
        return Tokenizers(ranks, model, digest, pa.array(texts_a, pa.binary()), pa.array(texts_b, pa.binary()))

    def ready(self) -> tuple:
        if self.digest not in _READY:
            import sentencepiece
            import tiktoken

            first = tiktoken.Encoding("first", pat_str=CUT, mergeable_ranks=self.ranks, special_tokens={})
            unit = tiktoken.Encoding("unit", pat_str="(?s).+", mergeable_ranks=self.ranks, special_tokens={})
            _READY[self.digest] = first, unit, sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return _READY[self.digest]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text."""
        first, unit, second = self.ready()
        a = [np.asarray(_first_ids(first, unit, " " + t), dtype=np.int64) for t in texts]
        b = [np.asarray(second.encode(t, num_threads=1), dtype=np.int64) for t in texts]
        return a, b


def _surfaces(ids: np.ndarray, of: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The joined bytes of ids, and where each token ends."""
    taken = of.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int32)[1 : len(ids) + 1]
    return memoryview(taken.buffers()[2] or b""), ends.astype(np.int64)


@dataclass
class Aligned:
    """The texts of a block that have tokens: ids and links of all of them in a row, and the bounds of each text."""

    rows: np.ndarray
    a: np.ndarray
    b: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray
    #: Link by link: place of its A token and of its B token.
    i: np.ndarray
    j: np.ndarray
    bounds_links: np.ndarray
    #: Number of groups that end before each token.
    group_a: np.ndarray
    group_b: np.ndarray
    bounds_groups: np.ndarray


def _bounds(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(list(sizes), dtype=np.int64))))


def align(texts: list[str | None], t: Tokenizers) -> Aligned:
    """Tokens, groups and links of a block of texts."""
    rows = [i for i, text in enumerate(texts) if text]
    a, b = t.encode([texts[i] for i in rows])
    empty = np.empty(0, dtype=np.int64)
    data_a, ends_a = _surfaces(np.concatenate([empty, *a]), t.bytes_a)
    data_b, ends_b = _surfaces(np.concatenate([empty, *b]), t.bytes_b)
    last_a, last_b = _bounds(map(len, a)), _bounds(map(len, b))
    ends_a, ends_b = np.concatenate(([0], ends_a)), np.concatenate(([0], ends_b))
    kept = []
    for k, row in enumerate(rows):
        whole = b" " + texts[row].encode()
        if all(bytes(d[e[s[k]] : e[s[k + 1]]]) == whole for d, e, s in ((data_a, ends_a, last_a), (data_b, ends_b, last_b))):
            kept.append(k)
    if len(kept) < len(rows):
        a, b = [a[k] for k in kept], [b[k] for k in kept]
        ends_a = np.concatenate(([0], _surfaces(np.concatenate([empty, *a]), t.bytes_a)[1]))
        ends_b = np.concatenate(([0], _surfaces(np.concatenate([empty, *b]), t.bytes_b)[1]))
        last_a, last_b = _bounds(map(len, a)), _bounds(map(len, b))
    # Byte by byte: whether a token of either side ends there. Both sides have the same bytes.
    stop_a, stop_b = (np.zeros(int(e[-1]) + 1, dtype=bool) for e in (ends_a, ends_b))
    stop_a[ends_a[1:]], stop_b[ends_b[1:]] = True, True
    both, any_ = stop_a & stop_b, stop_a | stop_b
    stops = np.flatnonzero(any_)
    texts_end = ends_a[last_a]
    return Aligned(
        rows=np.array([rows[k] for k in kept], dtype=np.int64),
        a=np.concatenate([empty, *a]),
        b=np.concatenate([empty, *b]),
        bounds_a=last_a,
        bounds_b=last_b,
        i=np.cumsum(stop_a)[stops - 1],
        j=np.cumsum(stop_b)[stops - 1],
        bounds_links=np.searchsorted(stops, texts_end, side="right"),
        group_a=np.cumsum(both)[ends_a[:-1]],
        group_b=np.cumsum(both)[ends_b[:-1]],
        bounds_groups=np.cumsum(both)[texts_end],
    )


def _printed(t: Tokenizers) -> pa.Array:
    """Each id as it is written in a digest: A ids with ``,`` then with ``|``, B ids with ``,``, with ``;``, and bare."""
    a, b = range(len(t.bytes_a)), range(len(t.bytes_b))
    forms = [*(f"{i}," for i in a), *(f"{i}|" for i in a), *(f"{i}," for i in b), *(f"{i};" for i in b), *map(str, b)]
    return pa.array([f.encode() for f in forms], pa.binary())


def group_digests(x: Aligned, t: Tokenizers, printed: pa.Array) -> list[str]:
    """SHA-256 of the groups of each text."""
    n_a, n_b = len(t.bytes_a), len(t.bytes_b)
    last_a = np.append(x.group_a[1:] != x.group_a[:-1], True)[: len(x.a)]
    last_b = np.append(x.group_b[1:] != x.group_b[:-1], True)[: len(x.b)]
    form_a = x.a + np.where(last_a, n_a, 0)
    form_b = 2 * n_a + x.b + np.where(last_b, n_b, 0)
    if len(x.b):
        form_b[x.bounds_b[1:] - 1] += n_b
    # An A token follows the B tokens of earlier groups, a B token the A tokens up to its own group.
    form = np.empty(len(x.a) + len(x.b), dtype=np.int64)
    form[np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a, side="left")] = form_a
    form[np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, side="right")] = form_b
    data, ends = _surfaces(form, printed)
    at = np.concatenate(([0], ends))[x.bounds_a + x.bounds_b]
    return [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(at, at[1:], strict=False)]


def _keys(x: Aligned, t: Tokenizers) -> np.ndarray:
    """Id pairs of the links as whole numbers."""
    return x.a[x.i] * len(t.bytes_b) + x.b[x.j]


def _pairs(sent):
    """(key, n): the linked pairs of a task and how often each occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, size = sent.value, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            found, place = np.unique(keys, return_inverse=True)
            return found, np.bincount(place, np.concatenate([n for _, n in held]), len(found)).astype(np.int64)

        for whole in batches:
            for batch in text_slices(whole):
                held.append(np.unique(_keys(align(batch.column("text").to_pylist(), t), t), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_pydict({"key": pa.array(held[0][0]), "n": pa.array(held[0][1])})
                        held, size = [], 0
        if held:
            keys, n = summed()
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "n": pa.array(n)})

    return run


# ---- minimal perfect hashing ----


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mixed(keys.view(np.uint64) + salt) % np.uint64(size)).astype(np.int64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(shards)).astype(np.int64)


@dataclass
class PerfectHash:
    """Levels of bits with the rank before each word of 64."""

    sizes: list[int]
    words: list[np.ndarray]
    ranks: list[np.ndarray]

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct."""
        sizes, words, left = [], [], keys
        while len(left):
            size = 64 * int(np.ceil(ROOM * len(left) / 64))
            at = _place(left, len(sizes), size)
            often = np.bincount(at, minlength=size)
            words.append(np.packbits(often == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[often[at] != 1]
        return PerfectHash(sizes, words, []).ranked()

    def ranked(self) -> PerfectHash:
        before = 0
        for words in self.words:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        return self

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or the index of another key if it is none of those built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(zip(self.sizes, self.words, self.ranks, strict=True)):
            at = _place(keys[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def packed(self) -> tuple[list[int], bytes]:
        return self.sizes, b"".join(w.tobytes() for w in self.words)

    @staticmethod
    def unpacked(sizes: list[int], data: bytes) -> PerfectHash:
        bounds = _bounds(s // 8 for s in sizes)
        words = [np.frombuffer(data[s:e], dtype=np.uint64) for s, e in zip(bounds, bounds[1:], strict=False)]
        return PerfectHash(list(sizes), words, []).ranked()


def _dealt(shards: int):
    """(shard, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_pydict({"shard": pa.array(_shard(keys, shards).astype(np.int32)), "key": batch.column("key")})

    return run


def _built(rows: pa.Table) -> pa.Table:
    """The hash of a shard and its keys by index."""
    keys = rows.column("key").to_numpy()
    made = PerfectHash.build(keys)
    ordered = np.empty_like(keys)
    ordered[made.index(keys)] = keys
    sizes, bits = made.packed()
    return pa.table(
        {
            "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([bits], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary()),
        }
    )


def _vectors(sent, shards: int, first: int):
    """(shard, counts, part): dense vectors of a task's counts over the shards of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, tuple[PerfectHash, int]] = sent.value
        sums = {}
        for batch in batches:
            keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            shard = _shard(keys, shards)
            for s, (found, size) in hashes.items():
                mine = shard == s
                if mine.any():
                    if s not in sums:
                        sums[s] = np.zeros(size, dtype=np.int64)
                    np.add.at(sums[s], found.index(keys[mine]), n[mine])
        for s, vector in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([s], pa.int32()), "counts": pa.array([zlib.compress(vector.tobytes(), 1)], pa.binary())}
            )

    return run


def _summed(rows: pa.Table) -> pa.Table:
    total = None
    for part in rows.column("counts"):
        vector = np.frombuffer(zlib.decompress(part.as_py()), dtype=np.int64)
        total = vector.copy() if total is None else total + vector
    return pa.table({"shard": rows.column("shard").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _summed_again(rows: pa.Table) -> pa.Table:
    return _summed(rows)


def _highest(width: int):
    """(b, n): the highest count of each B id in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                b = np.frombuffer(keys.as_py(), dtype=np.int64) % width
                found, place = np.unique(b, return_inverse=True)
                most = np.zeros(len(found), dtype=np.int64)
                np.maximum.at(most, place, np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.int64))
                yield pa.RecordBatch.from_pydict({"b": pa.array(found), "n": pa.array(most)})

    return run


@dataclass
class PairCounts:
    """Counts of all linked pairs: ``table`` (shard, sizes, bits, keys, counts), and the highest count per B id."""

    table: DataFrame
    shards: int
    most: np.ndarray

    def block(self, at: int, block_shards: int) -> dict[int, tuple[PerfectHash, np.ndarray, np.ndarray]]:
        rows = self.table.filter(F.col("shard").between(at, at + block_shards - 1)).collect()
        return {
            r["shard"]: (
                PerfectHash.unpacked(r["sizes"], bytes(r["bits"])),
                np.frombuffer(bytes(r["keys"]), dtype=np.int64),
                np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64),
            )
            for r in rows
        }


def count_pairs(docs: DataFrame, sent, shard: int = SHARD, block_shards: int = BLOCK_SHARDS) -> PairCounts:
    """First pass over ``docs`` (text): counts of all linked pairs. ``sent`` is the broadcast of the tokenizers."""
    context = docs.sparkSession.sparkContext
    pairs = stored(docs.select("text").mapInArrow(_pairs(sent), "key long, n long"), "align-pairs")
    distinct = stored(pairs.select("key").distinct(), "align-distinct")
    shards = max(1, -(-distinct.count() // shard))
    hashes = distinct.mapInArrow(_dealt(shards), "shard int, key long").groupBy("shard")
    hashes = stored(hashes.applyInArrow(_built, "shard int, sizes array<long>, bits binary, keys binary"), "align-hashes")
    sums = None
    for at in range(0, shards, block_shards):
        block = hashes.filter(F.col("shard").between(at, at + block_shards - 1))
        found = {
            r["shard"]: (PerfectHash.unpacked(r["sizes"], bytes(r["bits"])), r["size"])
            for r in block.select("shard", "sizes", "bits", (F.octet_length("keys") / 8).cast("int").alias("size")).collect()
        }
        vectors = pairs.mapInArrow(_vectors(context.broadcast(found), shards, at), "shard int, counts binary")
        part = vectors.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
        few = part.groupBy("shard", "part").applyInArrow(_summed, "shard int, counts binary")
        one = few.groupBy("shard").applyInArrow(_summed_again, "shard int, counts binary")
        sums = one if sums is None else sums.unionByName(one)
    counted = stored(hashes.join(sums, "shard"), "align-counts")
    width = len(sent.value.bytes_b)
    most = np.zeros(width, dtype=np.int64)
    highest = counted.select("keys", "counts").mapInArrow(_highest(width), "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    for row in highest.collect():
        most[row["b"]] = row["n"]
    return PairCounts(counted, shards, most)


def _lookup(block, keys: np.ndarray, shards: int) -> np.ndarray:
    """Count of each key; 0 for one of another block."""
    out = np.zeros(len(keys), dtype=np.int64)
    shard = _shard(keys, shards)
    for s, (found, kept, counts) in block.items():
        mine = np.flatnonzero(shard == s)
        index = found.index(keys[mine])
        sure = (index >= 0) & (kept[np.maximum(index, 0)] == keys[mine])
        out[mine[sure]] = counts[index[sure]]
    return out


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_DDL = ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string"


def _looked_up(sent, block, most, shards: int, first: bool, kept: list[str]):
    """Add the results of one block to the rows; digests are taken in the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, counts, highest = sent.value, block.value, most.value
        printed = _printed(t) if first else None
        for whole in batches:
            for batch in text_slices(whole):
                x = align(batch.column("text").to_pylist(), t)
                keys, place = np.unique(_keys(x, t), return_inverse=True)
                n = _lookup(counts, keys, shards)
                best = (n == highest[keys % len(t.bytes_b)]) & (n > 0)
                total = [np.concatenate(([0], np.cumsum(v[place]))) for v in (best.astype(np.int64), n)]
                values = [np.zeros(batch.num_rows, dtype=np.int64) for _ in _NUMBERS]
                sizes = [np.diff(b) for b in (x.bounds_a, x.bounds_b, x.bounds_groups, x.bounds_links)]
                for out, size in zip(values, [*sizes, *(np.diff(v[x.bounds_links]) for v in total)], strict=True):
                    out[x.rows] = size
                if first:
                    digests = [""] * batch.num_rows
                    for row, digest in zip(x.rows, group_digests(x, t, printed), strict=True):
                        digests[row] = digest
                    digests = pa.array(digests, pa.string())
                else:
                    for name, out in zip(_NUMBERS[-2:], values[-2:], strict=True):
                        out += batch.column(name).to_numpy()
                    digests = batch.column("groups_sha256")
                columns = [*(batch.column(c) for c in kept), *map(pa.array, values), digests]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *_NUMBERS, "groups_sha256"])

    return run


def aligned(docs: DataFrame, tokenizers: Tokenizers, shard: int = SHARD, block_shards: int = BLOCK_SHARDS) -> DataFrame:
    """doc_id, sizes, n_best, count_sum and the digest of the groups of each row."""
    rows = checked_columns(docs, {"doc_id": "long", "text": "string"})
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(tokenizers)
    counts = count_pairs(rows, sent, shard, block_shards)
    most = context.broadcast(counts.most)
    for at in range(0, counts.shards, block_shards):
        block = context.broadcast(counts.block(at, block_shards))
        last = at + block_shards >= counts.shards
        kept = ["doc_id"] if last else ["doc_id", "text"]
        ddl = "doc_id long, " + ("" if last else "text string, ") + _DDL
        rows = rows.mapInArrow(_looked_up(sent, block, most, counts.shards, at == 0, kept), ddl)
        if not last:
            rows = stored(rows, "align-rows")
    return rows


def default_tokenizers() -> Tokenizers:
    """The public vocabularies of this box; elsewhere pass their paths to ``Tokenizers.load``."""
    import public_tokenizers

    return Tokenizers.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_token_alignment")
def op12(spark, sf_dir) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), default_tokenizers())
