"""Penalised logistic fits from summed statistics: every fit of a grid in the same passes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.session import cut

STEPS = 50
ROWS_PER_TASK = 25_000
#: Rows that a task turns into a matrix at a time.
BLOCK = 1_000


@dataclass(frozen=True)
class LinearModel:
    """A decision value ``weights . x + offset`` over raw features; k-mer counts of lengths ``counted`` come before ``x``."""

    weights: np.ndarray
    offset: float
    counted: tuple[int, int] | None = None

    def score(self, x: str | Column, text: str | Column | None = None) -> Column:
        return F.get(decision_values([self], x, text), F.lit(0))


def decision_values(models: Sequence[LinearModel], x: str | Column, text: str | Column | None = None) -> Column:
    """The values of several models over the same features, as one array made in one pass.

    Batches go through numpy, so that hundreds of weights cost no expression tree, a block of
    rows at a time; equal rows score the same to the last bit.
    """
    counted = models[0].counted
    weights, offsets = [m.weights for m in models], [m.offset for m in models]

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            out = np.zeros((len(columns[0]), len(weights)))
            for start in range(0, len(out), BLOCK):
                part = slice(start, start + BLOCK)
                block = np.array(columns[0][part].tolist(), dtype=float).reshape(len(out[part]), -1)
                if counted is not None:
                    block = np.column_stack([kmer_matrix(columns[1][part], *counted), block])
                for i, (w, offset) in enumerate(zip(weights, offsets)):
                    out[part, i] = (block * w).sum(axis=1) + offset
            yield pd.Series(list(out))

    return values(x) if counted is None else values(x, text)


@dataclass(frozen=True)
class Fit:
    """One fit of a grid: inverse penalty strength, and whether classes weigh inversely to their size."""

    c: float = 1.0
    balanced: bool = False


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without NULLs as rows of one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def batch_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows (curvature row, gradient, loss) of one block; the last column of ``x`` is the constant."""
    z = x @ w
    p = 0.5 * (1 + np.tanh(z / 2))
    bend = (x * (weight * p * (1 - p))[:, None]).T @ x
    gradient = x.T @ (weight * (y - p))
    loss = np.zeros(len(w))
    loss[0] = (weight * (np.logaddexp(0, z) - y * z)).sum()
    return np.column_stack([bend, gradient, loss])


def _summed(
    data: DataFrame, mean: np.ndarray, scale: np.ndarray, share: dict[int, dict[int, float]], at: dict[int, np.ndarray],
    counted: tuple[int, int] | None = None,
):
    """Curvature, gradient and loss of every fit in ``at``, by one pass over the rows.

    A task sends one row per fit and feature; they are summed by feature, with partial
    sums where they arise. The driver gets as many numbers as a Hessian has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = (_matrix(part.column(0)) - mean) / scale
                ahead = [] if counted is None else [kmer_matrix(part.column(2).to_pylist(), *counted)]
                x = np.column_stack([*ahead, x, np.ones(len(x))])
                y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                for f, w in at.items():
                    weight = np.where(y == 1, share[f][1], share[f][0])
                    sums[f] = sums.get(f, 0.0) + batch_sums(x, y, weight, w)
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                names=["fit", "i", "v"],
            )

    parts = data.mapInArrow(run, "fit int, i int, v array<double>")
    found = parts.groupBy("fit", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    size = len(next(iter(at.values())))
    out = {f: np.zeros((size, size + 2)) for f in at}
    for r in found:
        out[r["fit"]][r["i"]] = r["v"].toArray()
    return {f: (m[:, :size], m[:, size], m[0, size + 1]) for f, m in out.items()}


def fit_logistic(
    rows: DataFrame, x: str, label: str, fits: Sequence[Fit] = (Fit(),), counted: tuple[str, int, int] | None = None, tol: float = 1e-9
) -> list[LinearModel]:
    """Penalised logistic fits with an unpenalised constant, all fits of ``fits`` together.

    ``x`` is an array column of one length without NULLs. Its features are centred and
    divided by their sample deviation first; a constant one stays as it is. With ``counted``
    (text column, shortest, longest) the k-mer counts of a text come before ``x``, as they
    are: each pass counts them where the rows lie, so that only the text is stored. Each Newton step is one pass that sums gradient, curvature
    and loss of all fits still moving; a step that makes a loss larger is halved. Rows with a
    NULL array or label are left out. Both classes must be there.
    """
    text, lengths = ([], None) if counted is None else ([F.col(counted[0]).alias("text")], counted[1:])
    used = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), *text)
    data = cut(used.dropna(subset=["x", "y"]))
    stat = data.groupBy("y").agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s")
    ).select("y", "s.mean", "s.variance", "s.count").collect()
    counts = {r["y"]: r["count"] for r in stat}
    if set(counts) != {0, 1}:
        raise ValueError(f"labels 0 and 1 wanted, found {sorted(counts)}")
    total = sum(counts.values())
    mean = sum(r["mean"].toArray() * r["count"] for r in stat) / total
    # Within the classes, then between them: no difference of large squares.
    square = sum(r["variance"].toArray() * (r["count"] - 1) + r["count"] * (r["mean"].toArray() - mean) ** 2 for r in stat)
    scale = np.sqrt(square / (total - 1))
    scale[scale == 0] = 1.0
    ahead = 0 if lengths is None else kmer_places(*lengths)[-1]
    share = {f: {k: total / (2 * n) if fit.balanced else 1.0 for k, n in counts.items()} for f, fit in enumerate(fits)}
    few = data.coalesce(1 + total // ROWS_PER_TASK)
    penalty = {f: np.append(np.full(ahead + len(mean), 1 / fit.c), 0.0) for f, fit in enumerate(fits)}
    at = {f: np.zeros(ahead + len(mean) + 1) for f in range(len(fits))}
    last: dict[int, tuple[np.ndarray, float]] = {}
    done = {}
    for _ in range(STEPS):
        moved = {}
        for f, (bend, gradient, loss) in _summed(few, mean, scale, share, at, lengths).items():
            w = at[f]
            loss = loss + 0.5 * (penalty[f] * w * w).sum()
            if f in last and loss > last[f][1] + 1e-9 * abs(last[f][1]):
                moved[f] = (w + last[f][0]) / 2
                continue
            last[f] = (w, loss)
            gradient = gradient - penalty[f] * w
            step = np.linalg.solve(bend + np.diag(penalty[f]), gradient)
            # The step doubles the digits: after a gain this small the next one changes nothing that shows.
            (done if gradient @ step <= tol else moved)[f] = w + step
        at = moved
        if not at:
            break
    else:
        raise RuntimeError(f"{len(at)} fits still move after {STEPS} steps")
    models = []
    for f in range(len(fits)):
        w = done[f][:-1].copy()
        w[ahead:] /= scale
        models.append(LinearModel(w, float(done[f][-1] - (w[ahead:] * mean).sum()), lengths))
    return models


def kmer_places(low: int, high: int) -> np.ndarray:
    """Where the k-mers of each length start among all of them, and at the end how many there are."""
    return np.cumsum([0, *[4**k for k in range(low, high + 1)]])


def kmer_numbers(texts: Iterable[str | None], low: int, high: int) -> np.ndarray:
    """One number for each k-mer over A, C, G, T of each text: its row times the number of all k-mers, plus its place."""
    code = np.full(256, -1, dtype=np.int8)
    code[np.frombuffer(b"ACGT", dtype=np.uint8)] = range(4)
    encoded = [(s or "").encode() for s in texts]
    starts = kmer_places(low, high)
    # Half the bytes sort in half the time.
    kind = np.int32 if len(encoded) * starts[-1] < np.iinfo(np.int32).max else np.int64
    none = np.iinfo(kind).max
    # One separator that is no letter ends every text, so that no k-mer spans two.
    letters = code[np.frombuffer(b"".join(t + b"-" for t in encoded), dtype=np.uint8)]
    row = np.repeat(np.arange(len(encoded), dtype=kind) * kind(starts[-1]), [len(t) + 1 for t in encoded])
    number, bad = np.zeros(len(letters), dtype=kind), np.zeros(len(letters), dtype=bool)
    wrong, parts = letters < 0, [np.zeros(0, dtype=kind)]
    for k in range(1, min(high, len(letters)) + 1):
        n = len(letters) - k + 1
        number, bad = number[:n] * kind(4) + letters[k - 1 :], bad[:n] | wrong[k - 1 :]
        if k >= low:
            parts.append(np.where(bad, none, row[:n] + (number + kind(starts[k - low]))))
    found = np.concatenate(parts)
    return found[found < none]


def kmer_table(texts: Sequence[str | None], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of the k-mers that texts have, by row, then place."""
    found = np.sort(kmer_numbers(texts, low, high))
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
    row, place = np.divmod(found[first], found.dtype.type(kmer_places(low, high)[-1]))
    return row, place, np.diff(first, append=len(found))


def kmer_matrix(texts: Iterable[str | None], low: int, high: int) -> np.ndarray:
    """Counts of all k-mers over A, C, G, T, one row per text, by k, then in letter order."""
    texts = list(texts)
    size = kmer_places(low, high)[-1]
    return np.bincount(kmer_numbers(texts, low, high), minlength=len(texts) * size).astype(float).reshape(len(texts), size)


def kmer_counts(seq: str | Column, low: int, high: int) -> Column:
    """Counts of all k-mers over A, C, G, T with low <= k <= high, by k, then in letter order; others do not count.

    A k-mer's place is its number in base 4, so no vocabulary is needed. NULL gives zeros.
    """

    @F.pandas_udf("array<double>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([row for i in range(0, len(batch), BLOCK) for row in kmer_matrix(batch[i : i + BLOCK], low, high)])

    return counted(seq)
