"""The logistic loss over all pairs of a positive and a negative row, from sums over single rows.

A pair's loss depends on the difference of two scores only. So the loss of all pairs and its slope at a
score are sums of one smooth function over the scores of the other class, and those follow from the
masses of the scores on an even grid: a row spreads over the nodes around its score as
interpolation reads a value from them. No pair is ever listed and none is left out; with polynomials
through eight nodes 1/16 apart the sums are right to about 1e-12 of their size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distance of the nodes, and how many of them one score spreads over.
STEP = 1 / 16
SPREAD = 8
_AHEAD = SPREAD // 2 - 1
_BASIS = np.linalg.inv(np.vander(np.arange(SPREAD) - _AHEAD, SPREAD, increasing=True).astype(float))
#: Step lengths tried in one pass over the rows, and former steps that shape the next one.
LENGTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1.0, 2.0)
MEMORY = 10

#: Rows that a task lays out at a time.
BLOCK = 250


class Features(Protocol):
    """What a fit asks of a block of rows with ``size`` features each."""

    size: int

    def scores(self, part: pa.RecordBatch, *weights: np.ndarray) -> list[np.ndarray]:
        """Inner products of the rows with each of the weights."""

    def sums(self, part: pa.RecordBatch, by: np.ndarray, squared: bool = False) -> np.ndarray:
        """Sum of the rows' features, or of their squares, each row times its entry of ``by``."""


def on_grid(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nodes around each score, and the share of each of them."""
    below = np.floor(scores / STEP)
    return below.astype(np.int64) - _AHEAD, np.vander(scores / STEP - below, SPREAD, increasing=True) @ _BASIS


@dataclass(frozen=True)
class Slopes:
    """Loss of all pairs by the weight of one each, and its slope at the score of a row of either class."""

    loss: float
    first: int
    positive: np.ndarray
    negative: np.ndarray

    def at(self, scores: np.ndarray, y: np.ndarray) -> np.ndarray:
        node, share = on_grid(scores)
        node = (node - self.first)[:, None] + np.arange(SPREAD)
        return (np.where(y[:, None] == 1, self.positive[node], self.negative[node]) * share).sum(axis=1)


def slopes(masses: dict[int, dict[int, float]]) -> Slopes:
    """From the masses of the scores by class and node."""
    nodes = [*masses[0], *masses[1]]
    # One more at both ends: the same score may round to either side of a node.
    first, size = min(nodes) - 1, max(nodes) - min(nodes) + 3
    mass = np.zeros((2, size))
    for y, of in masses.items():
        mass[y, np.array(list(of)) - first] = list(of.values())
    apart = np.arange(1 - size, size) * STEP
    rising = 0.5 * (1 + np.tanh(apart / 2))
    # Seen from a positive row, the negatives behind it; seen from a negative row, the positives before it.
    above = np.convolve(1 - rising, mass[0], "valid")
    lost = np.convolve(np.logaddexp(0, -apart), mass[0], "valid")
    return Slopes(float(mass[1] @ lost), first, -above, np.convolve(rising, mass[1], "valid"))


def _masses(data: DataFrame, features: Features, w: np.ndarray, d: np.ndarray, lengths: tuple[float, ...]) -> list[dict]:
    """Masses by class and node of the scores of ``w`` and a step of each length along ``d``; the driver gets one number per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], float] = defaultdict(float)
        for part in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            y = part.column("y").to_numpy()
            from_, along = features.scores(part, w, d)
            for i, length in enumerate(lengths):
                node, share = on_grid(from_ + length * along)
                low = node.min()
                for c in (0, 1):
                    of = (node[y == c] - low)[:, None] + np.arange(SPREAD)
                    found = np.bincount(of.ravel(), share[y == c].ravel())
                    for n in np.flatnonzero(found):
                        sums[i, c, int(n + low)] += found[n]
        step, label, node = np.array(list(sums), dtype=np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (step, label, node, np.array(list(sums.values()), dtype=float))], names=["i", "c", "node", "mass"])

    out = [{0: {}, 1: {}} for _ in lengths]
    for r in data.mapInArrow(run, "i long, c long, node long, mass double").groupBy("i", "c", "node").agg(F.sum("mass").alias("mass")).collect():
        out[r["i"]][r["c"]][r["node"]] = r["mass"]
    return out


def _summed(data: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """One vector per task, added up by ``add`` a block of rows at a time, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            add(total, part)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    return data.mapInArrow(run, "v array<double>").agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"].toArray()


def fit_all_pairs(data: DataFrame, features: Features, c: float, max_iter: int, tol: float) -> np.ndarray:
    """Weights of the penalised logistic loss on the score differences of all pairs of a positive and a negative row.

    ``data`` has the label ``y`` (int, 0 or 1) next to what ``features`` reads. All pairs together weigh as much as
    the larger class has rows, so ``c`` means what it means for one pair per row. Two passes a step, by
    L-BFGS from the diagonal of the curvature: one spreads the scores of several step lengths on the
    grid, the other sums the gradient. Steps end when one gains no more than ``tol`` of the loss.
    """
    counts = {r["y"]: r["count"] for r in data.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"labels 0 and 1 wanted, found {sorted(counts)}")
    pairs = counts[0] * counts[1]
    penalty, size = 1 / (2 * c * max(counts.values())), features.size

    def moments(total: np.ndarray, part: pa.RecordBatch) -> None:
        y = part.column("y").to_numpy()
        total += np.concatenate([features.sums(part, (y == k).astype(float), squared) for k in (0, 1) for squared in (False, True)])

    zero, zero2, one, one2 = np.split(_summed(data, 4 * size, moments), 4)
    w = np.zeros(size)
    loss = float(np.log(2))
    gradient = (zero / counts[0] - one / counts[1]) / 2
    scale = 1 / ((one2 / counts[1] + zero2 / counts[0] - 2 * one * zero / pairs) / 4 + penalty)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        d, back = -gradient, []
        for s, t in reversed(past):
            back.append((s @ d) / (s @ t))
            d = d - back[-1] * t
        # The diagonal, as long as the last step found the curvature to be.
        d = scale * d * (past[-1][0] @ past[-1][1] / (past[-1][1] ** 2 @ scale) if past else 1.0)
        for (s, t), a in zip(past, reversed(back)):
            d = d + (a - (t @ d) / (s @ t)) * s
        found = [slopes(m) for m in _masses(data, features, w, d, LENGTHS)]
        losses = [f.loss / pairs + penalty / 2 * (v @ v) for f, v in zip(found, (w + n * d for n in LENGTHS))]
        best = int(np.argmin(losses))
        gained = loss - losses[best]
        if gained <= 0 and past:
            # Former steps mislead: once more without them.
            past = []
            continue
        if gained <= 0:
            break
        step = LENGTHS[best] * d
        w, loss, at = w + step, losses[best], found[best]

        def slope(total: np.ndarray, part: pa.RecordBatch, w: np.ndarray = w, at: Slopes = at) -> None:
            total += features.sums(part, at.at(features.scores(part, w)[0], part.column("y").to_numpy()))

        if gained <= tol * loss:
            break
        before, gradient = gradient, _summed(data, size, slope) / pairs + penalty * w
        past = [*past, (step, gradient - before)][-MEMORY:]
    return w
