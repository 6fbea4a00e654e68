"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

Document statistics, standardised over the training rows, go through cosines of fixed
random directions, whose inner products approximate a Gaussian kernel. Every task sums
the normal equations of its rows; the sums add up to two half models and the whole
one. The half models score each other's rows, and pooled adjacent violators over the
binned scores turn a score of the whole model into a probability.

A NULL text counts as empty and gets a score like any other. Labels that are NULL or
have no document are not used; a document labelled twice counts twice. Without labels of
both kinds every score is the share of the label that there is, or 0.5. A NULL doc_id is
never held out. Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import checked_columns, packed, stored, table, unpacked
from sitelab.llm.decision_list import FEATURES, statistics
from sitelab.llm.registry import query

WAVES = 256
WIDTH = 2.5
RIDGE = 0.5
BINS = 512
#: Labelled rows used at most, chosen by a hash of doc_id: the documented bound of the fit.
LABELLED = 1_000_000
#: Tasks that sum normal equations; each sends one matrix per half, (WAVES + 1)^2 doubles.
SUMMING = 8
THRESHOLD = 0.3
#: Rows whose waves are made at a time.
ROWS = 4096


@dataclass(frozen=True)
class Kernel:
    """A fitted model; ``knots`` are the steps of the calibration (raw score, probability)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        blocks = (x[at : at + ROWS] for at in range(0, max(len(x), 1), ROWS))
        return np.concatenate([waves((block - self.mean) / self.scale) @ self.weights for block in blocks])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = self.raw(x)
        # A thousandth of the raw score keeps the order within a step.
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def waves(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, with a constant column."""
    draw = np.random.default_rng(814)
    directions = draw.normal(size=(x.shape[1], WAVES)) / WIDTH
    shift = draw.uniform(0, 2 * np.pi, WAVES)
    z = np.cos(np.clip(x, -8, 8) @ directions + shift) * np.sqrt(2 / WAVES)
    return np.hstack([z, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]).astype(float)


def _sums(mean: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WAVES + 1, WAVES + 2))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                z = waves((_matrix(batch) - mean) / scale)
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
                half = batch.column("half").to_numpy(zero_copy_only=False)
                for h in (0, 1):
                    zh = z[half == h]
                    total[h, :, :-1] += zh.T @ zh
                    total[h, :, -1] += zh.T @ y[half == h]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _solve(total: np.ndarray) -> np.ndarray:
    return np.linalg.solve(total[:, :-1] + RIDGE * np.eye(len(total)), total[:, -1])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over binned points sorted by x; bounded by the number of bins."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _bins(halves: list[Kernel]):
    """Counts of out-of-half scores by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, half = _matrix(batch), batch.column("half").to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, halves[1].raw(x), halves[0].raw(x)) if len(x) else np.empty(0)
            place = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(place, pa.int32()), "raw": pa.array(raw), "y": batch.column("y")})

    return run


def held_out(fold: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold)) == rest, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Kernel:
    """A model of label 1 from (doc_id, quality); ``stats`` holds FEATURES per doc_id."""
    marked = checked_columns(labels, {"doc_id": "long", "quality": "int"}).filter(F.col("quality").isin(0, 1))
    rows = stats.select("doc_id", *FEATURES).join(marked, "doc_id")
    rows = rows.select(
        *FEATURES,
        F.col("quality").alias("y"),
        F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"),
        F.pmod(F.xxhash64("doc_id", F.lit("kernel")), F.lit(1_000_000)).alias("draw"),
    )
    rows = stored(rows, "kernel-rows")
    total, good = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not total or good in (0, total):
        return Kernel(np.zeros(0), np.ones(0), np.zeros(0), None, good / total if total else 0.5)
    rows = rows.filter(F.col("draw") < int(min(1.0, bound / total) * 1_000_000))
    moments = rows.agg(*[F.avg(f) for f in FEATURES], *[F.stddev_pop(f) for f in FEATURES]).first()
    mean = np.array(moments[: len(FEATURES)], dtype=float)
    scale = np.array(moments[len(FEATURES) :], dtype=float)
    scale = np.where(scale > 1e-12, scale, 1.0)
    parts = rows.drop("draw").repartition(SUMMING).mapInArrow(_sums(mean, scale), "sums binary").collect()
    sums = sum(np.frombuffer(p["sums"]).reshape(2, WAVES + 1, WAVES + 2) for p in parts)
    halves = [Kernel(mean, scale, _solve(s), None) for s in sums]
    binned = (
        rows.drop("draw")
        .mapInArrow(_bins(halves), "bin int, raw double, y int")
        .groupBy("bin")
        .agg(F.avg("raw"), F.avg("y"), F.count(F.lit(1)))
        .orderBy("bin")
        .collect()
    )
    knots = isotonic(*(np.array([r[i] for r in binned], dtype=float) for i in (1, 2, 3)))
    return Kernel(mean, scale, _solve(sums[0] + sums[1]), knots)


def score_column(model: Kernel) -> Column:
    """The score of a row of FEATURES. Only these go to Python: the texts and whatever else is in the row stay in the JVM."""

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    return score(F.array(*FEATURES))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, score) of every document; only rows with ``train`` lend their labels."""
    stats = stored(statistics(docs).select("doc_id", *FEATURES), "kernel-stats")
    model = fit(stats if train is None else stats.filter(train), labels)
    return stats.select("doc_id", score_column(model).alias("score"))


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more.

    Each row is judged by its own text, whatever its doc_id: it is kept beside its statistics.
    """
    stats = stored(statistics(packed(docs, "doc_id", "text"), "_row").select("doc_id", *FEATURES, "_row"), "kernel-stats")
    return unpacked(stats.filter(score_column(fit(stats, labels)) >= threshold), docs.columns)


@query("op8_quality_classifier")
def op8(spark, sf_dir) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return scores.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
