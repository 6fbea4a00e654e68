"""Hard negatives by angular triangle filtering.

Each row stores its angles to a few reference directions, a spread-out choice from a
sample of rows. Angles are a metric, so for an anchor ``a`` and a row ``x``
``|t(a) - t(x)| <= angle(a, x) <= t(a) + t(x)`` for each reference; the cosines of the
tightest two, times both lengths and widened for rounding, bound the score from above and
below. A row's score is computed, as an exact whole number, only if its bounds overlap the
window still open for the anchor:

* positives: from the worst of the best rows so far upwards;
* negatives: for each positive, from the window's lower end (or the worst of its best
  negatives so far) to the window's upper end.

Rows lie sorted by their nearest reference and the angle to it, so that the bounds of a
whole tile often rule it out at once. Anchors go to the tasks in blocks of at most
``BLOCK`` numbers, whatever the size of the table; each task meets its rows with the block
and returns its best rows per anchor, of which Spark keeps the first. Rows do not travel.

The references come from at most ``SAMPLE`` rows with the smallest hashes; they only set
how much is ruled out, never the result.

Rows with a NULL vec_id, label or vector, or with NULL or non-finite components, take no
part. Scores are between vectors of one length; an empty vector has score 0 with other
empty ones. Repeated rows are rows of their own: a second row of an anchor's vec_id is one
of its positives, and both are anchors. A window of a negative positive score is empty. Scores beyond 64
bits are an error. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelab.llm.common import checked_columns, stored, table
from sitelab.llm.registry import query
from sitelab.operators.ordering import global_rank

#: Numbers of a block of anchors: 8 MB.
BLOCK = 1 << 20
SAMPLE = 2048
REFERENCES = 8
TILE = 512
#: Anchors that are compared with a tile at once.
CHUNK = 1024
#: Angles are widened by this; it covers the rounding of the arc cosine near its ends.
SLACK = 1e-6
#: Below this, sums of products of whole numbers are exact in double precision.
EXACT = 2.0**53


def references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions: each next one is the row furthest in angle from those taken."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    taken, near = [unit[0]], unit @ unit[0]
    while len(taken) < count:
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-9:
            break
        taken.append(unit[at])
        near = np.maximum(near, unit @ unit[at])
    return np.array(taken)


def angles(q: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, angles to the references) of rows; a zero row has angle 0, which its length makes harmless."""
    norm = np.linalg.norm(q, axis=1)
    cosine = (q / np.where(norm > 0, norm, 1)[:, None]) @ refs.T if len(refs) else np.zeros((len(q), 0))
    return norm, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(na: np.ndarray, ta: np.ndarray, nx: np.ndarray, tx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of each anchor with each row."""
    apart, around = np.zeros((len(na), len(nx))), np.full((len(na), len(nx)), np.pi)
    for r in range(ta.shape[1]):
        np.maximum(apart, np.abs(ta[:, r, None] - tx[None, :, r]), out=apart)
        total = ta[:, r, None] + tx[None, :, r]
        np.minimum(around, total, out=around)
        # Two rows near the opposite of the reference are no further apart than by this.
        np.minimum(around, 2 * np.pi - total, out=around)
    size = na[:, None] * nx[None, :]
    high = size * (np.cos(np.maximum(apart - SLACK, 0)) + 1e-9)
    low = size * (np.cos(np.minimum(around + SLACK, np.pi)) - 1e-9)
    return low, high


def tile_highest(na: np.ndarray, ta: np.ndarray, nx: np.ndarray, tx: np.ndarray) -> np.ndarray:
    """Highest score of each anchor with any row of a tile."""
    if not ta.shape[1]:
        return na * nx.max() * (1 + 1e-9)
    below, above = tx.min(axis=0)[None, :] - ta, ta - tx.max(axis=0)[None, :]
    apart = np.maximum(np.maximum(below, above), 0).max(axis=1)
    cosine = np.cos(np.maximum(apart - SLACK, 0))
    return na * (np.where(cosine > 0, nx.max(), nx.min()) * cosine + nx.max() * 1e-9)


def scores(qa: np.ndarray, qx: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, every left with every right one."""
    if not qa.size or not qx.size:
        return np.zeros((len(qa), len(qx)), dtype=np.int64)
    most = float(np.abs(qa).max()) * float(np.abs(qx).max()) * qa.shape[1]
    if most < EXACT:
        return (qa @ qx.T).astype(np.int64)
    if most < 2.0**62:
        return qa.astype(np.int64) @ qx.astype(np.int64).T
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in qx] for a in qa], dtype=object)
    if any(abs(v) >= 1 << 63 for v in exact.flat):
        raise ValueError("a score does not fit into 64 bits")
    return exact.astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each slot: higher scores first, ties by the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.zeros((slots, k), dtype=np.int64)
        self.id = np.zeros((slots, k), dtype=np.int64)
        self.n = np.zeros(slots, dtype=np.int64)
        #: A row needs this score at least.
        self.need = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        held = np.arange(self.k)[None, :] < self.n[touched][:, None]
        slot = np.concatenate((slot, np.repeat(touched, self.k)[held.ravel()]))
        score = np.concatenate((score, self.score[touched][held]))
        ids = np.concatenate((ids, self.id[touched][held]))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        first = place < self.k
        slot, place = slot[first], place[first]
        self.score[slot, place], self.id[slot, place] = score[first], ids[first]
        self.n[touched] = np.bincount(slot, minlength=len(self.n))[touched]
        full = touched[self.n[touched] == self.k]
        self.need[full] = self.score[full, -1]

    def batch(self, numbers: np.ndarray, name: str) -> pa.RecordBatch:
        """(anchor or slot number, id, score) of all that is held."""
        held = np.arange(self.k)[None, :] < self.n[:, None]
        columns = {name: np.repeat(numbers, self.k)[held.ravel()], "id": self.id[held], "score": self.score[held]}
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


@dataclass
class Anchors:
    """Anchors of one length of vector: number, row, label, whole numbers, lengths and angles."""

    number: np.ndarray
    uid: np.ndarray
    label: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    theta: np.ndarray
    #: Slots of each anchor's positives (first, one past the last) and the windows of all slots.
    slots: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    slot_number: np.ndarray | None = None


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(float)


def _tiles(batches: Iterator[pa.RecordBatch]):
    """(dim, ids, uids, labels, q, norms, angles) of runs of rows with vectors of one length."""
    for whole in batches:
        dims = whole.column("dim").to_numpy()
        edges = np.flatnonzero(np.diff(dims)) + 1
        for s, e in zip([0, *edges], [*edges, len(dims)], strict=True):
            for at in range(s, e, TILE):
                part = whole.slice(at, min(TILE, e - at))
                dim = int(dims[s])
                theta = part.column("theta")
                width = len(theta[0]) if len(theta) else 0
                yield (
                    dim, part.column("vec_id").to_numpy(), part.column("uid").to_numpy(), part.column("label").to_numpy(),
                    _matrix(part.column("q"), dim), part.column("norm").to_numpy(), _matrix(theta, width),
                )


def _positives(sent, k: int):
    """(anchor, id, score): the best rows of the anchor's label in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, Anchors] = sent.value
        best = {dim: Best(len(a.number), k) for dim, a in block.items()}
        for dim, ids, uids, labels, q, norm, theta in _tiles(batches):
            if dim not in block:
                continue
            a, held = block[dim], best[dim]
            near = np.isin(a.label, labels) & (tile_highest(a.norm, a.theta, norm, theta) >= held.need)
            picked = np.flatnonzero(near)
            for at in range(0, len(picked), CHUNK):
                s = picked[at : at + CHUNK]
                _, high = score_bounds(a.norm[s], a.theta[s], norm, theta)
                open_ = (a.label[s][:, None] == labels[None, :]) & (a.uid[s][:, None] != uids[None, :]) & (high >= held.need[s][:, None])
                for label in np.unique(a.label[s]):
                    rows = np.flatnonzero(labels == label)
                    mine = np.flatnonzero((a.label[s] == label) & open_[:, rows].any(axis=1))
                    rows = rows[open_[np.ix_(mine, rows)].any(axis=0)]
                    found = scores(a.q[s[mine]], q[rows])
                    keep = open_[np.ix_(mine, rows)] & (found >= held.need[s[mine]][:, None])
                    i, j = np.nonzero(keep)
                    held.add(s[mine[i]], found[i, j], ids[rows[j]])
        for dim, a in block.items():
            yield best[dim].batch(a.number, "anchor")

    return run


def _negatives(sent, k: int):
    """(slot, id, score): the best rows of other labels within each positive's window in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, Anchors] = sent.value
        best = {}
        for dim, a in block.items():
            best[dim] = Best(len(a.low), k)
            best[dim].need[:] = a.low
        for dim, ids, _, labels, q, norm, theta in _tiles(batches):
            if dim not in block:
                continue
            a, held = block[dim], best[dim]
            least = np.full(len(a.number), np.inf)
            owner = np.repeat(np.arange(len(a.number)), np.diff(a.slots))
            np.minimum.at(least, owner, np.maximum(held.need, a.low))
            picked = np.flatnonzero(tile_highest(a.norm, a.theta, norm, theta) >= least)
            for at in range(0, len(picked), CHUNK):
                s = picked[at : at + CHUNK]
                low, high = score_bounds(a.norm[s], a.theta[s], norm, theta)
                other = a.label[s][:, None] != labels[None, :]
                width = np.diff(a.slots)[s]
                turns = [(turn, np.flatnonzero(width > turn)) for turn in range(int(width.max(initial=0)))]
                open_ = np.zeros(other.shape, dtype=bool)
                for turn, mine in turns:
                    slot = a.slots[s[mine]] + turn
                    open_[mine] |= (high[mine] >= np.maximum(held.need, a.low)[slot][:, None]) & (low[mine] <= a.high[slot][:, None])
                open_ &= other
                left, rows = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                found = np.full(other.shape, np.iinfo(np.int64).min)
                found[np.ix_(left, rows)] = scores(a.q[s[left]], q[rows])
                for turn, mine in turns:
                    slot = a.slots[s[mine]] + turn
                    keep = open_[mine] & (found[mine] >= held.need[slot][:, None]) & (found[mine] <= a.high[slot][:, None])
                    keep &= found[mine] >= a.low[slot][:, None]
                    i, j = np.nonzero(keep)
                    held.add(slot[i], found[mine[i], j], ids[j])
        for dim, a in block.items():
            yield best[dim].batch(a.slot_number, "slot")

    return run


def _measured(sent):
    """Rows with whole numbers, length, angles, and the place they lie at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = sent.value
        for whole in batches:
            for row in range(0, whole.num_rows, 4096):
                batch = whole.slice(row, 4096)
                dims = batch.column("dim").to_numpy()
                norms, near, turn = np.zeros(len(dims)), np.zeros(len(dims), dtype=np.int64), np.zeros(len(dims))
                thetas: list = [None] * len(dims)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    q = _matrix(batch.column("q").take(pa.array(at)), int(dim))
                    norm, theta = angles(q, refs.get(int(dim), np.zeros((0, int(dim)))))
                    norms[at] = norm
                    if theta.shape[1]:
                        near[at] = theta.argmin(axis=1)
                        turn[at] = theta.min(axis=1)
                    for place, t in zip(at, theta, strict=True):
                        thetas[place] = t
                columns = {c: batch.column(c) for c in ("vec_id", "label", "dim", "q")}
                columns |= {"norm": pa.array(norms), "theta": pa.array(thetas, pa.list_(pa.float64()))}
                columns |= {"near": pa.array(near), "turn": pa.array(turn)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _block(rows: list) -> dict[int, Anchors]:
    """Anchors by length of vector, from rows in order of their numbers."""
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        some = [r for r in rows if r["dim"] == dim]
        whole = lambda name: np.array([r[name] for r in some], dtype=np.int64)
        width = len(some[0]["theta"])
        out[dim] = Anchors(
            whole("number"), whole("uid"), whole("label"),
            np.array([r["q"] for r in some], dtype=float).reshape(len(some), dim),
            np.array([r["norm"] for r in some]),
            np.array([r["theta"] for r in some], dtype=float).reshape(len(some), width),
        )
    return out


def _with_windows(block: dict[int, Anchors], rows: list, positives: int, low: int, high: int) -> dict[int, Anchors]:
    """The block with a slot per positive whose window can hold a score; (low, high) are percent of the positive's score."""
    windows: dict[int, list] = {}
    for r in rows:
        score = r["score"]
        # Whole numbers throughout: the window's ends, rounded inwards.
        ends = -(-low * score // 100), high * score // 100
        if ends[0] <= ends[1]:
            windows.setdefault(r["anchor"], []).append((r["anchor"] * positives + r["rank"] - 1, *ends))
    out = {}
    for dim, a in block.items():
        mine = [windows.get(int(n), []) for n in a.number]
        flat = [w for some in mine for w in some]
        a.slots = np.concatenate(([0], np.cumsum([len(some) for some in mine])))
        a.slot_number, a.low, a.high = (np.array([w[i] for w in flat], dtype=np.int64) for i in range(3))
        out[dim] = a
    return out


def _first(found: DataFrame, by: str, k: int) -> DataFrame:
    """The first ``k`` of each group, with their rank; every task has sent at most ``k`` a group."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sound_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, q): rows that take part, with whole-number components."""
    rows = checked_columns(vectors, {"vec_id": "long", "embedding": "array<double>", "label": "int"})
    e = F.col("embedding")
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).filter(F.forall(e, number))
    # F.floor gives a long; ``x - pmod(x, 1)`` stays a double, exact for whole numbers beyond 64 bits.
    q = F.transform(e, lambda v: v * 256.0 - F.pmod(v * 256.0, F.lit(1.0)))
    return rows.select("vec_id", "label", F.size(e).alias("dim"), q.alias("q"))


def mine(
    rows: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block: int = BLOCK,
) -> DataFrame:
    """Hard negatives of every ``every``-th vec_id; ``rows`` has vec_id, label, dim and whole-number components q.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    drawn = rows.select("dim", "q").withColumn("h", F.xxhash64("q")).orderBy("h", "dim").limit(SAMPLE).collect()
    refs = {}
    for d in {r["dim"] for r in drawn}:
        some = [r["q"] for r in drawn if r["dim"] == d]
        refs[d] = references(np.array(some, dtype=float).reshape(len(some), d))
    kind = "vec_id long, label int, dim int, q array<double>, norm double, theta array<double>, near long, turn double"
    measured = rows.mapInArrow(_measured(spark.sparkContext.broadcast(refs)), kind)
    place = ["dim", "near", "turn", "vec_id"]
    laid = measured.repartitionByRange(*place).sortWithinPartitions(*place)
    laid = stored(laid.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    chosen = laid.filter(F.col("vec_id") % every == 0)
    anchors = stored(global_rank(chosen.drop("near", "turn"), ["vec_id", "uid"], name="number"), "negatives-anchors")
    count, dim = anchors.agg(F.count(F.lit(1)), F.max("dim")).first()
    step = max(1, block // max(dim or 1, 1))
    found = None
    for at in range(1, count + 1, step):
        part = anchors.filter(F.col("number").between(at, at + step - 1))
        held = _block(part.orderBy("number").collect())
        best = laid.mapInArrow(_positives(spark.sparkContext.broadcast(held), positives), "anchor long, id long, score long")
        best = stored(_first(best, "anchor", positives), "negatives-positives")
        windows = _with_windows(held, best.collect(), positives, low, high)
        taken = laid.mapInArrow(_negatives(spark.sparkContext.broadcast(windows), negatives), "slot long, id long, score long")
        taken = _first(taken, "slot", negatives).select(
            "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
            F.floor(F.col("slot") / positives).alias("anchor"), (F.col("slot") % positives + 1).cast("int").alias("place"),
        )
        wanted = best.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = part.select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        rows_ = taken.join(wanted, ["anchor", "place"]).join(named, "anchor")
        rows_ = rows_.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
        rows_ = stored(rows_, "negatives-found")
        found = rows_ if found is None else found.unionByName(rows_)
    if found is None:
        kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], kind)
    return found


SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_dot_product(a.q, x.q)::BIGINT AS score
  FROM sound a JOIN sound x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id AND len(a.q) = len(x.q)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY m.score DESC, m.id))::INTEGER AS rank,
  m.id AS negative_id, p.positive_score, m.score AS negative_score
FROM positives p JOIN met m ON p.anchor_id = m.anchor_id AND NOT m.same
  AND 30 * p.positive_score <= 100 * m.score AND 100 * m.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", SQL)
def op13(spark, sf_dir) -> DataFrame:
    rows = sound_rows(table(spark, sf_dir, "embeddings"))
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return mine(rows.withColumn("label", changed))
