"""N-gram Jaccard join by vertical partitioning.

All distinct word n-grams have one global order, rare ones first: the order of (level,
hash), where the level is the logarithm of how often the n-gram's cell of a fixed count
table was hit in the whole corpus. Two sets above the threshold share an n-gram among
the first ``n - ceil(t * n) + 1`` of each (prefix filter), so only sets that meet in such
a bucket are compared. For the comparison the order is cut into fragments of equal mass;
a set becomes one segment per fragment, the overlap of a pair is counted fragment by
fragment, each on its own, and the parts are summed.

Only connectivity is asked for, so not every pair is needed. Equal sets are one class. A
bucket of up to SMALL classes gives its pairs, which is linear in its rows; pairs with too
few common buckets are left out, since sets above the threshold share most of a prefix.
In a larger bucket all classes meet two centres first, one of them the class with the
fewest n-grams of its own; what that joins is one component. Then the classes around a
centre that are still apart from it are compared with all others around it: in tiles of
bounded size, where each fragment gives one matrix of partial overlaps and the matrices
add up. Those pairs never become rows. A pair that meets in a larger bucket is covered
there, any other one in its small buckets, so no link between components is lost.

Words are lower-cased in A-Z. NULL and empty texts, and texts without words, have no
n-grams and link with nothing. Documents with a NULL doc_id are counted but link with
nothing and have a NULL component. Rows that share a doc_id with other texts are
compared by each text, and repeated rows are one set. A very long text is one set in one
task. An empty table gives no rows. Extra columns are ignored.

Texts are read three times and never shuffled; a filter of fixed size keeps most n-grams
that only one text has, and the sets that no pair asks for, out of the shuffles. Tables
written on the way are deleted as soon as what was read from them is written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import ROW_KEY, checked_columns, discard, mixed, packed, row_key, shingle_set, stored, table, text_slices, unpacked
from sitelab.llm.registry import query
from sitelab.operators.components import connected_components

#: Cells of the count table, a fixed size: four bytes each while counting, one when sent to the tasks.
CELL_BITS = 22
PIECE = 1 << 16
LEVELS = 256
FRAGMENTS = 8
#: Bits of a filter that is sent to the tasks, a fixed size: 4 MB.
FILTER_BITS = 25
#: Rows of a table that is sent to the tasks instead of dealing the rows it meets.
LOOKED_UP = 100_000
#: Classes of a bucket that gives all its pairs.
SMALL = 16
#: Classes of a tile.
TILE = 256


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _texts(batch: pa.RecordBatch):
    for part in text_slices(batch):
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            yield doc, text.encode() if text else b""


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_FACTS = pa.schema(
    [("doc", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())]
)


def _facts(k: int):
    """Per text its number of n-grams and the key of its set; at the end the cell counts of the task, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in batches:
            docs, sizes, keys, waiting = [], [], [], []
            for doc, text in _texts(batch):
                s = shingle_set(text, k)
                docs.append(doc)
                sizes.append(len(s))
                keys.append(_key(s) if len(s) else None)
                waiting.append(_cells(s))
                if sum(map(len, waiting)) > 1 << 20 or len(waiting) > 4096:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32)
                    waiting = []
            if waiting:
                counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32)
            none = pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *none], schema=_FACTS
            )
        for piece in range(len(counts) // PIECE):
            part = counts[piece * PIECE : (piece + 1) * PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                        pa.array([piece], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()),
                    ],
                    schema=_FACTS,
                )

    return run


def _summed(table_: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, dtype=np.uint64)
    for part in table_.column("counts"):
        total += np.frombuffer(zlib.decompress(part.as_py()), dtype=table_.column("kind")[0].as_py())
    return pa.table(
        {"piece": pa.array([table_.column("piece")[0].as_py()], pa.int32()), "kind": ["u8"], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())}
    )


@dataclass
class Order:
    """The global order: a level per cell, and where levels lie in the mass of all n-grams."""

    levels: np.ndarray
    start: np.ndarray
    mass: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.levels[_cells(h)]

    def fragment(self, h: np.ndarray, parts: int) -> np.ndarray:
        level = self.of(h)
        place = self.start[level] + self.mass[level] * (h.astype(float) / 2.0**64)
        return np.minimum((place * parts).astype(np.int64), parts - 1)


def _order(pieces: DataFrame) -> Order:
    """Sum the cell counts in two steps; what comes to the driver is the table of fixed size."""
    kind = "piece int, kind string, counts binary"
    tagged = pieces.select("piece", F.lit("u4").alias("kind"), "counts", F.spark_partition_id().alias("part"))
    some = tagged.groupBy("piece", F.pmod("part", F.lit(32))).applyInArrow(_summed_first, kind)
    rows = some.groupBy("piece").applyInArrow(_summed_again, kind).collect()
    counts = np.zeros(1 << CELL_BITS)
    for row in rows:
        at = row["piece"] * PIECE
        counts[at : at + PIECE] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint64)
    levels = np.minimum(np.floor(8 * np.log2(1 + counts)), LEVELS - 1).astype(np.uint8)
    mass = np.bincount(levels, weights=counts, minlength=LEVELS) / max(counts.sum(), 1)
    return Order(levels, np.cumsum(mass) - mass, mass)


def _summed_first(rows: pa.Table) -> pa.Table:
    return _summed(rows)


def _summed_again(rows: pa.Table) -> pa.Table:
    return _summed(rows)


def _filter_bits(h: np.ndarray) -> np.ndarray:
    return (mixed(h.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _packed_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in batches:
        bits[_filter_bits(batch.column(0).to_numpy())] = True
    if bits.any():
        yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})


def _joined_bits(rows: pa.Table) -> pa.Table:
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for part in rows.column("bits"):
        bits |= np.frombuffer(zlib.decompress(part.as_py()), dtype=np.uint8)
    return pa.table({"bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})


def membership(values: DataFrame):
    """Broadcast filter of fixed size over a column of whole numbers.

    What is in the column always passes; of the rest the more is let through the fuller the
    filter, so it saves shuffling and never decides.
    """
    parts = values.mapInArrow(_packed_bits, "bits binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = parts.groupBy("part").applyInArrow(_joined_bits, "bits binary").collect()
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for row in some:
        bits |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return values.sparkSession.sparkContext.broadcast(bits)


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _filter_bits(h)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _prefix(s: np.ndarray, rank: Order, percent: int) -> np.ndarray:
    """The first n-grams of a set in the global order."""
    n = len(s)
    most = n + (-percent * n) // 100 + 1
    # Ascending by (level, hash): the hashes are sorted already, so a stable sort by level is enough.
    return s[np.argsort(rank.of(s), kind="stable")[:most]]


def _first_ngrams(order, k: int, percent: int):
    """(s, k8): the first n-grams of each text and 64 bits of the key of its set; a set is sent once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = order.value, set()
        for batch in batches:
            parts, keys = [], []
            for doc, text in _texts(batch):
                s = shingle_set(text, k)
                if doc is None or not len(s) or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                parts.append(_prefix(s, rank, percent))
                keys.append(int.from_bytes(key[:8], "little", signed=True))
            if parts:
                repeated = np.repeat(np.array(keys, dtype=np.int64), [len(p) for p in parts])
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.concatenate(parts).view(np.int64)), "k8": pa.array(repeated)})

    return run


def _shared_prefixes(order, shared, k: int, percent: int):
    """(s, key, n, pos) of those first n-grams of each text that pass the filter; a set is sent once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bits, seen = order.value, shared.value, set()
        for batch in batches:
            parts: list[tuple[np.ndarray, np.ndarray, bytes, int]] = []
            for doc, text in _texts(batch):
                s = shingle_set(text, k)
                if doc is None or not len(s) or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                first = _prefix(s, rank, percent)
                at = np.flatnonzero(_passes(first, bits))
                if len(at):
                    parts.append((first[at], at, key, len(s)))
            if parts:
                length = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "s": pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                        "key": pa.array([p[2] for p in parts], pa.binary()).take(pa.array(np.repeat(np.arange(len(parts)), length))),
                        "n": pa.array(np.repeat([p[3] for p in parts], length).astype(np.int64)),
                        "pos": pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64)),
                    }
                )

    return run


def _segments(order, wanted, k: int, fragments: int):
    """(key, f, part): the n-grams by fragment of the texts whose doc_id passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bits = order.value, wanted.value
        for whole in batches:
            ids = whole.column("doc_id")
            some = whole.take(pa.array(np.flatnonzero(_passes(ids.fill_null(0).to_numpy(), bits) & ids.is_valid().to_numpy(zero_copy_only=False))))
            for batch in text_slices(some):
                keys, places, parts = [], [], []
                for _, text in _texts(batch):
                    s = shingle_set(text, k)
                    if not len(s):
                        continue
                    key, f = _key(s), rank.fragment(s, fragments)
                    for place in np.unique(f):
                        keys.append(key)
                        places.append(int(place))
                        parts.append(s[f == place].view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(keys, pa.binary()), "f": pa.array(places, pa.int32()),
                        "part": pa.array(parts, pa.list_(pa.int64())),
                    }
                )

    return run


def _fetched(docs: DataFrame, keys: DataFrame, classes: DataFrame, order, k: int, fragments: int) -> DataFrame:
    """(key, f, part) of the classes in ``keys``: texts do not travel, only the segments of wanted ones."""
    wanted = stored(keys.distinct().join(classes, "key"), "jaccard-wanted")
    bits = membership(wanted.select("rep"))
    segments = docs.mapInArrow(_segments(order, bits, k, fragments), "key binary, f int, part array<long>")
    # A text that is there twice gives its segments twice.
    segments = segments.join(wanted.select("key"), "key", "left_semi").groupBy("key", "f").agg(F.first("part").alias("part"))
    out = stored(segments, "jaccard-segments")
    discard(wanted)
    return out


def overlaps(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order, k: int, fragments: int = FRAGMENTS) -> DataFrame:
    """(a, b, na, nb, overlap) of pairs of keys: partial counts by fragment, summed."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    segments = _fetched(docs, wanted, classes, order, k, fragments)
    left = pairs.join(segments.withColumnRenamed("key", "a").withColumnRenamed("part", "pa"), "a")
    both = left.join(segments.withColumnRenamed("key", "b").withColumnRenamed("part", "pb"), ["b", "f"])
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("common"))
    out = stored(counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("overlap")), "jaccard-overlaps")
    discard(segments)
    return out


def _pair(x: str, y: str) -> list:
    """Columns of a candidate pair, the smaller key first."""
    swap = F.col(f"{x}.key") > F.col(f"{y}.key")
    pick = lambda name, first: F.when(swap == first, F.col(f"{y}.{name}")).otherwise(F.col(f"{x}.{name}"))
    return [
        pick("key", True).alias("a"), pick("key", False).alias("b"),
        pick("n", True).alias("na"), pick("n", False).alias("nb"),
        pick("pos", True).alias("ia"), pick("pos", False).alias("ib"),
    ]


def _sized(x: str, y: str, percent: int):
    return F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent


def _near(percent: int):
    """What stands before the first common place on either side cannot be shared."""
    return (F.col("ia") + F.col("ib")) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _ceil(value, by: int):
    """Exact division of whole numbers, rounded up."""
    return F.floor((value + (by - 1)) / by)


def _small_pairs(bucket: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of pairs that may reach the threshold by their common small buckets.

    At least ``o`` n-grams must be common, so at most ``n - o`` of a prefix are not; the
    prefix that ends first lies, as far as it is common, within the other one.
    """
    me = bucket.select("s", F.struct("key", "n", "pos").alias("x"))
    met = me.join(me.withColumnRenamed("x", "y"), "s").filter((F.col("x.key") < F.col("y.key")) & _sized("x", "y", percent))
    once = met.select(*_pair("x", "y")).groupBy("a", "b", "na", "nb").agg(
        F.count(F.lit(1)).alias("common"), F.min("ia").alias("ia"), F.min("ib").alias("ib")
    )
    least = _ceil((F.col("na") + F.col("nb")) * percent, 100 + percent) - _ceil(F.greatest("na", "nb") * percent, 100) + 1
    return once.filter((F.col("common") >= least) & _near(percent)).select("a", "b", "na", "nb")


def _centres(bucket: DataFrame) -> DataFrame:
    """Two centres per bucket: where the bucket's n-gram comes first in the order, and one by hash."""
    me = F.struct("key", "n", "pos", "comp")
    draw = F.xxhash64("key")
    return bucket.groupBy("s").agg(
        F.min(F.struct("pos", draw.alias("h"), me.alias("me"))).alias("first"), F.min(F.struct(draw.alias("h"), me.alias("me"))).alias("any")
    ).select("s", F.col("first.me").alias("centre"), F.col("any.me").alias("second"))


def _looked_up(rows: DataFrame, table_: DataFrame, on: str) -> DataFrame:
    """Rows with what a table of one row per ``on`` says: a small table goes to the rows, so a hot value does not gather them."""
    return rows.join(F.broadcast(table_) if table_.count() <= LOOKED_UP else table_, on)


def _centre_pairs(bucket: DataFrame, percent: int) -> DataFrame:
    me = F.struct("key", "n", "pos", "comp")
    both = F.array_distinct(F.array("centre", "second"))
    met = _looked_up(bucket, stored(_centres(bucket), "jaccard-centres"), "s").select(me.alias("x"), F.explode(both).alias("y"))
    apart = (F.col("x.key") != F.col("y.key")) & _sized("x", "y", percent)
    return met.filter(apart).select(*_pair("x", "y")).filter(_near(percent)).select("a", "b", "na", "nb").distinct()


def _tiled(bucket: DataFrame, tile: int) -> DataFrame:
    """(g, key, n, comp, low, high, at): classes around a centre by pair of tiles.

    Classes apart from the centre's component come first in the numbering of tiles; a pair
    of tiles holds at least one tile of theirs.
    """
    met = _looked_up(bucket, stored(_centres(bucket), "jaccard-centres"), "s").select(
        F.col("centre.key").alias("g"), "key", "n", "comp", (F.col("comp") != F.col("centre.comp")).alias("apart")
    )
    around = stored(met.distinct(), "jaccard-around")
    sizes = around.groupBy("g").agg(
        F.ceil(F.sum(F.col("apart").cast("long")) / tile).cast("int").alias("outer"),
        F.ceil(F.sum((~F.col("apart")).cast("long")) / tile).cast("int").alias("inner"),
    )
    placed = around.join(sizes.filter(F.col("outer") > 0), "g")
    draw = lambda count: F.pmod(F.xxhash64("key"), F.greatest(count, F.lit(1))).cast("int")
    at = F.when(F.col("apart"), draw(F.col("outer"))).otherwise(F.col("outer") + draw(F.col("inner")))
    last = F.when(F.col("apart"), F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    spread = placed.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    return spread.select("g", "key", "n", "comp", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at")


def tile_links(parts: list[dict[int, np.ndarray]], sizes: np.ndarray, comps: list, left: np.ndarray, right: np.ndarray, percent: int):
    """Index pairs (one of ``left``, one of ``right``) of different components above the threshold.

    Overlaps are counted per fragment, over n-grams that lie on both sides, and summed.
    """
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    none = np.empty(0, dtype=np.int64)
    for f in {f for p in parts for f in p}:
        a, b = ([parts[i].get(f, none) for i in side] for side in (left, right))
        common = np.intersect1d(np.concatenate([none, *a]), np.concatenate([none, *b]))
        for at in range(0, len(common), 4096):
            some = common[at : at + 4096]
            total += (_hits(a, some) @ _hits(b, some).T).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - total
    number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([number[c] for c in comps])
    return np.nonzero((total * 100 >= union * percent) & (comp[left][:, None] != comp[right][None, :]))


def _hits(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Membership of sorted values in each set, as a matrix."""
    out = np.zeros((len(sets), len(values)), dtype=np.float32)
    for i, members in enumerate(sets):
        place = np.searchsorted(values, members)
        inside = place < len(values)
        place = place[inside]
        out[i, place[values[place] == members[inside]]] = 1
    return out


def _tile_pairs(percent: int):
    """Rows of one pair of tiles follow each other; what leaves is a link per class and component met."""

    def links(rows: dict) -> Iterator[tuple[bytes, bytes]]:
        keys = list(rows)
        at = np.array([rows[k][2] for k in keys])
        sizes, comps, parts = np.array([rows[k][0] for k in keys]), [rows[k][1] for k in keys], [rows[k][3] for k in keys]
        low, high = at.min(), at.max()
        left = np.flatnonzero(at == low)
        right = left if low == high else np.flatnonzero(at == high)
        i, j = tile_links(parts, sizes, comps, left, right, percent)
        met = set()
        for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True):
            if (a, comps[b]) not in met:
                met.add((a, comps[b]))
                yield keys[a], keys[b]

    def batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, found = None, {}, []
        for whole in batches:
            at_batch = (whole.column(c).to_pylist() for c in ("g", "low", "high", "key", "n", "comp", "at", "f"))
            lists = whole.column("part")
            for row, (g, low, high, key, n, comp, at, f) in enumerate(zip(*at_batch, strict=True)):
                if (g, low, high) != current:
                    if rows:
                        found.extend(links(rows))
                    current, rows = (g, low, high), {}
                rows.setdefault(key, (n, comp, at, {}))[3][f] = lists[row].values.to_numpy()
            if len(found) > 10_000:
                yield batch(found)
                found = []
        if rows:
            found.extend(links(rows))
        yield batch(found)

    return run


def _apart_links(docs: DataFrame, bucket: DataFrame, classes: DataFrame, order, k: int, percent: int, tile: int) -> DataFrame:
    """Links between components among the classes around each centre."""
    tiled = stored(_tiled(bucket, tile), "jaccard-tiled")
    segments = _fetched(docs, tiled.select("key"), classes, order, k, FRAGMENTS)
    laid = tiled.join(segments, "key").repartition("g", "low", "high").sortWithinPartitions("g", "low", "high", "key")
    pairs = laid.select("g", "low", "high", "key", "n", "comp", "at", "f", "part").mapInArrow(_tile_pairs(percent), "a binary, b binary")
    out = stored(pairs, "jaccard-apart")
    discard(tiled, segments)
    return out


def _with_components(bucket: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket rows with ``comp``, only of buckets that hold two components or more."""
    joined = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    marked = stored(bucket.join(joined, "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component"), "jaccard-marked")
    open_ = marked.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("s")
    out = stored(_looked_up(marked, stored(open_, "jaccard-open-buckets"), "s"), "jaccard-open")
    discard(marked)
    return out


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of
    ``100 * intersection >= percent * union``.
    """
    docs = checked_columns(docs, {"doc_id": "long", "text": "string"})
    facts = stored(docs.mapInArrow(_facts(k), "doc long, n long, key binary, piece int, counts binary"), "jaccard-facts")
    rank = _order(facts.filter(F.col("piece").isNotNull()).select("piece", "counts"))
    order = docs.sparkSession.sparkContext.broadcast(rank)
    sets = facts.filter(F.col("piece").isNull()).select("doc", "n", "key")
    classes = stored(
        sets.filter(F.col("key").isNotNull() & F.col("doc").isNotNull()).groupBy("key").agg(F.min("doc").alias("rep")),
        "jaccard-classes",
    )
    first = docs.mapInArrow(_first_ngrams(order, k, percent), "s long, k8 long")
    several = first.groupBy("s").agg(F.min("k8").alias("lo"), F.max("k8").alias("hi")).filter("lo != hi").select("s")
    several = stored(several, "jaccard-shared")
    met = docs.mapInArrow(_shared_prefixes(order, membership(several), k, percent), "s long, key binary, n long, pos long")
    bucket = stored(met.join(several, "s").dropDuplicates(["s", "key"]), "jaccard-buckets")
    discard(several)
    sizes = stored(bucket.groupBy("s").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > small).select("s"), "jaccard-sizes")
    large = stored(_looked_up(bucket, sizes, "s"), "jaccard-large")
    centred = _centre_pairs(large.withColumn("comp", F.col("key")), percent)
    few = bucket.join(F.broadcast(sizes) if sizes.count() <= LOOKED_UP else sizes, "s", "left_anti")
    pairs = stored(_small_pairs(few, percent).union(centred).distinct(), "jaccard-pairs")
    discard(bucket, sizes)
    counted = overlaps(docs, pairs, classes, order, k)
    links = stored(_linked(counted, percent), "jaccard-links")
    discard(pairs, counted)
    open_ = _with_components(large, links)
    discard(large)
    links = links.unionByName(_apart_links(docs, open_, classes, order, k, percent, tile))
    joined = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    known = stored(classes.join(joined, "key", "left").withColumn("_c", F.coalesce("component", "key")), "jaccard-known")
    lowest = known.groupBy("_c").agg(F.min("rep").alias("component_id"))
    named = known.join(lowest, "_c").select("key", "component_id")
    out = sets.join(named, "key", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def _linked(counted: DataFrame, percent: int) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("overlap")
    return counted.filter(F.col("overlap") * 100 >= union * percent).select("a", "b")


def one_of_each_text(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose text is the first of its component, by doc_id with NULL last.

    A row is known by its doc_id and its text (``row_key``), a NULL doc_id being one like any
    other: unrelated texts under one id all stay, copies among rows without an id go. Of rows
    that are alike in both one stays. Texts without words link with nothing. Rows are written
    once with a number; only numbers are compared, and the rows meet those that stay.
    """
    rows = stored(packed(docs).withColumn("_id", F.monotonically_increasing_id()), "jaccard-rows")
    plain = rows.select("_id", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    keys = plain.select("_id", *row_key())
    found = jaccard_components(plain.select(F.col("_id").alias("doc_id"), "text"), k, percent)
    found = found.select(F.col("doc_id").alias("_id"), "n_shingles", "component_id").join(keys, "_id")
    alike = [F.when(F.col("n_shingles") == 0, F.col(c)).alias(f"_{c}") for c in ROW_KEY]
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_component")
    first = found.groupBy(group, *alike).agg(F.min(F.struct(*ROW_KEY, "_id")).alias("_first"))
    return unpacked(rows.join(first.select(F.col("_first._id").alias("_id")), "_id", "left_semi"), docs.columns)


@query("op3_jaccard_join")
def op3(spark, sf_dir) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
