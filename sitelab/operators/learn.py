"""Feature building, linear models, centroid scores, and hard-negative mining."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelab.functions.scoring import sigmoid
from sitelab.operators.calibrate import logistic
from sitelab.operators.newton import ROWS_PER_TASK, Fit, decision_values, fit_logistic, kmer_numbers, kmer_places, kmer_table
from sitelab.operators.ordering import global_rank, top_k
from sitelab.operators.pairs import fit_all_pairs
from sitelab.operators.ranking import best_per_sequence
from sitelab.session import cut, new_path


def dot(x: str | Column, weights: Sequence[float]) -> Column:
    """Inner product of an array column with constant weights."""
    x = F.col(x) if isinstance(x, str) else x
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def squared_norm(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


@dataclass(frozen=True)
class CentroidModel:
    """A linear score ``w.x + b``, divided by the norm of x for the cosine form."""

    weights: list[float]
    offset: float
    by_norm: bool
    mean: float = 0.0
    sd: float = 1.0

    def score(self, x: str | Column) -> Column:
        value = dot(x, self.weights) + self.offset
        return value / F.greatest(F.sqrt(squared_norm(x)), F.lit(1e-8)) if self.by_norm else value

    def probability(self, x: str | Column) -> Column:
        return sigmoid((self.score(x) - self.mean) / self.sd)


def fit_centroids(df: DataFrame, x: str, label: str, method: str) -> CentroidModel:
    """cosine, euclidean or mahalanobis (diagonal) distance to class centroids.

    The difference of two squared distances is linear in x, so one inner product
    scores a row. The centroids are two short vectors per fit.
    """
    vector = array_to_vector(F.col(x).cast("array<double>"))
    rows = df.select(F.col(label).alias("y"), vector.alias("v"))
    means = {r["y"]: r["m"].toArray() for r in rows.groupBy("y").agg(Summarizer.mean(F.col("v")).alias("m")).collect()}
    p, n = means[1], means[0]
    if method == "cosine":
        w = p / max(np.linalg.norm(p), 1e-8) - n / max(np.linalg.norm(n), 1e-8)
        model = CentroidModel(w.tolist(), 0.0, True)
    else:
        v = np.ones_like(p)
        if method == "mahalanobis":
            s = rows.agg(
                Summarizer.metrics("variance", "count").summary(F.col("v")).alias("s")
            ).select("s.variance", "s.count").first()
            # Population variance from the sample variance.
            v = s["variance"].toArray() * (s["count"] - 1) / s["count"] + 1e-4
        elif method != "euclidean":
            raise ValueError(method)
        model = CentroidModel((2 * (p - n) / v).tolist(), float(((n**2 - p**2) / v).sum()), False)
    scored = df.select(model.score(x).alias("s"))
    stat = scored.agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    return CentroidModel(model.weights, model.offset, model.by_norm, stat["m"], max(stat["d"], 1e-8))


def layer_norm_head(
    x: str | Column,
    scale: Sequence[float],
    shift: Sequence[float],
    weights: Sequence[float],
    bias: float,
    epsilon: float = 1e-5,
) -> Column:
    """Probability of a layer norm followed by one linear unit.

    With mean m and deviation s of the entries, the unit's input is
    sum(scale*weight*x)/s - m*sum(scale*weight)/s plus a constant.
    """
    x = F.col(x) if isinstance(x, str) else x
    sw = [a * b for a, b in zip(scale, weights)]
    constant = sum(a * b for a, b in zip(shift, weights)) + bias
    size = len(sw)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / size
    variance = squared_norm(x) / size - mean * mean
    value = (dot(x, sw) - mean * sum(sw)) / F.sqrt(variance + epsilon) + constant
    return sigmoid(value)


def pool_tokens(tokens: DataFrame, key: str, position: str, vector: str, centre: int, length: int) -> DataFrame:
    """Centre, mean over the letters, mean under a mask, and first token of each sequence.

    Token rows are (key, position, vector, mask); positions 0 and length+1 are the
    start and end tokens.
    """
    v = array_to_vector(F.col(vector).cast("array<double>"))
    letter = F.col(position).between(1, length)
    masked = letter & (F.col("mask") == 1)
    rows = tokens.withColumns({"_x": v, "_letter": letter.cast("double"), "_masked": masked.cast("double")})
    return rows.groupBy(key).agg(
        F.max(F.when(F.col(position) == centre, F.col(vector))).alias("centre"),
        vector_to_array(Summarizer.mean(F.col("_x"), F.col("_letter"))).alias("mean"),
        vector_to_array(Summarizer.mean(F.col("_x"), F.col("_masked"))).alias("masked_mean"),
        F.max(F.when(F.col(position) == 0, F.col(vector))).alias("cls"),
    )


def kmer_logistic(train: DataFrame, label: str, numerics: Sequence[str], seq: str = "seq", c: float = 1.0):
    """1-4-mer counts with standardised composition numbers. Returns a scoring function."""
    numbers = _numbers(numerics, None)
    (model,) = fit_logistic(train.select(numbers.alias("x"), label, F.col(seq).alias("text")), "x", label, [Fit(c)], ("text", 1, 4))
    return lambda df: df.withColumn("score", model.score(numbers, seq))


def _numbers(numerics: Sequence[str], array: str | None) -> Column:
    parts = [] if array is None else [F.col(array).cast("array<double>")]
    return F.concat(*parts, F.array(*[F.col(n).cast("double") for n in numerics]).cast("array<double>"))


def numeric_logistic(
    train: DataFrame, label: str, numerics: Sequence[str], c: float = 1.0, balanced: bool = False, array: str | None = None
):
    """Standardised numbers, optionally next to an embedding array. Returns a scoring function."""
    features = _numbers(numerics, array)
    (model,) = fit_logistic(train.select(features.alias("x"), label), "x", label, [Fit(c, balanced)])
    return lambda df: df.withColumn("score", model.score(features))


def probe_grid(
    train: DataFrame, dev: DataFrame, label: str, array: str, cs: Sequence[float], balances: Sequence[bool]
) -> DataFrame:
    """Development scores of every (C, class weight) probe, long by model_id; all probes are fitted together."""
    fits = [Fit(c, balanced) for c, balanced in itertools.product(cs, balances)]
    models = fit_logistic(train, array, label, fits)
    names = F.array(*[F.lit(f"C{f.c:g}_weight_{'balanced' if f.balanced else 'none'}") for f in fits])
    probes = F.arrays_zip(names.alias("model_id"), decision_values(models, array).alias("score"))
    return dev.withColumn("_probe", F.explode(probes)).select(*dev.columns, "_probe.score", "_probe.model_id")


def principal_components(train: DataFrame, array: str, k: int):
    """Centred principal components fitted on one table. Returns a transform to an array column ``pc``."""
    stages = [
        StandardScaler(inputCol="_vector", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="_pc"),
    ]
    prepare = lambda df: df.withColumn("_vector", array_to_vector(F.col(array).cast("array<double>")))
    model = Pipeline(stages=stages).fit(prepare(train))
    return lambda df: model.transform(prepare(df)).withColumn("pc", vector_to_array("_pc")).drop("_vector", "_centred", "_pc")


@F.udf(VectorUDT())
def _sparse(size, places, values):
    return SparseVector(size, places, values)


# Stopping rule for models on many correlated counts; more steps no longer change the ranking.
COARSE = {"max_iter": 100, "tol": 1e-4}
#: Rows whose thousands of k-mer counts a task holds at a time.
WIDE_BLOCK = 250


def document_frequencies(rows: DataFrame, seq: str, low: int, high: int) -> np.ndarray:
    """In how many texts each k-mer occurs: one vector of counts per task, summed where they arise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kmer_places(low, high)[-1])
        for batch in batches:
            for start in range(0, batch.num_rows, WIDE_BLOCK):
                total += np.bincount(kmer_table(batch.column(0).slice(start, WIDE_BLOCK).to_pylist(), low, high)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    found = rows.select(seq).mapInArrow(run, "v array<double>").agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"]
    return np.zeros(kmer_places(low, high)[-1]) if found is None else found.toArray()


def sublinear(counts: np.ndarray) -> np.ndarray:
    """1 + log of counts from 1 on, looked up."""
    return (1.0 + np.log(np.arange(1, counts.max(initial=1) + 1)))[counts - 1]


@dataclass(frozen=True)
class KmerNumbers:
    """Sublinear TF-IDF k-mers of unit length next to standardised numbers, made in numpy where the rows lie."""

    low: int
    high: int
    idf: np.ndarray
    mean: np.ndarray
    factor: np.ndarray

    def kmers(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, value) of all k-mers of the vocabulary, by row, then place."""
        row, place, value = self.weighted(texts)
        return row, place, value / np.sqrt(np.bincount(row, value * value, minlength=len(texts)))[row]

    def weighted(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``kmers`` before they come to unit length."""
        row, place, count = kmer_table(texts, self.low, self.high)
        known = self.idf[place] > 0
        row, place, count = row[known], place[known], count[known]
        return row, place, sublinear(count) * self.idf[place]

    def numbers(self, values: Sequence[Sequence[float]]) -> np.ndarray:
        return (np.array([list(v) for v in values], dtype=float).reshape(len(values), len(self.mean)) - self.mean) * self.factor

    def matrix(self, texts: Sequence[str | None], values: Sequence[Sequence[float]]) -> np.ndarray:
        row, place, value = self.kmers(texts)
        out = np.zeros((len(texts), len(self.idf)))
        out[row, place] = value
        return np.column_stack([out, self.numbers(values)])

    def margin(self, weights: np.ndarray, seq: str, numbers: Column) -> Column:
        """Inner product of the features with ``weights``; equal rows score the same to the last bit."""

        @F.pandas_udf("double")
        def value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for texts, values in batches:
                out = np.zeros(len(texts))
                for start in range(0, len(out), WIDE_BLOCK):
                    part = slice(start, start + WIDE_BLOCK)
                    row, place, v = self.kmers(texts[part].tolist())
                    out[part] = np.bincount(row, v * weights[place], minlength=len(out[part]))
                    out[part] += (self.numbers(values[part].tolist()) * weights[len(self.idf) :]).sum(axis=1)
                yield pd.Series(out)

        return value(seq, numbers)


def _kmer_numbers(rows: DataFrame, numbers: Column, seq: str, low: int, high: int) -> KmerNumbers:
    """Scales of the features over ``rows``: k-mers of fewer than two texts are left out, a constant number is 0."""
    stat = rows.select(array_to_vector(numbers).alias("v")).agg(Summarizer.metrics("mean", "std", "count").summary(F.col("v")).alias("s"))
    stat = stat.select("s.mean", "s.std", "s.count").first()
    seen = document_frequencies(rows, seq, low, high)
    idf = np.where(seen >= 2, np.log((stat["count"] + 1) / (seen + 1)) + 1.0, 0.0)
    sd = stat["std"].toArray()
    return KmerNumbers(low, high, idf, stat["mean"].toArray(), np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0))


def pairwise_ranker(
    rows: DataFrame,
    pairs: DataFrame,
    key: str,
    numerics: Sequence[str],
    seq: str = "seq",
    c: float = 1.0,
    low: int = 3,
    high: int = 6,
):
    """Logistic ranker on feature differences of (positive_id, negative_id) pairs.

    Features are sublinear TF-IDF k-mers over A, C, G, T of unit length next to
    standardised numbers, and there is no intercept. A pair and its mirror image have
    the same loss, so each pair enters once, with a sign by hash, and counts twice.
    """
    numbers = _numbers(numerics, None)
    # Written once: the scales and both sides of the pairs read it.
    used = cut(rows.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"), numbers.alias("_x")))
    features = _kmer_numbers(used, F.col("_x"), "_seq", low, high)
    left = used.select(F.col("_key").alias("positive_id"), F.col("_seq").alias("_ps"), F.col("_x").alias("_px"))
    right = used.select(F.col("_key").alias("negative_id"), F.col("_seq").alias("_ns"), F.col("_x").alias("_nx"))
    flip = F.pmod(F.xxhash64("positive_id", "negative_id"), F.lit(2)) == 1
    both = pairs.join(left, "positive_id").join(right, "negative_id").select("_ps", "_px", "_ns", "_nx", flip.alias("_flip"))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, WIDE_BLOCK):
                ps, px, ns, nx, flips = (c.to_pylist() for c in batch.slice(start, WIDE_BLOCK).columns)
                x = features.matrix(ps, px) - features.matrix(ns, nx)
                x[np.array(flips)] *= -1.0
                places = [np.flatnonzero(v) for v in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.shape[1]] * len(x), pa.int32()),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array([v[p] for v, p in zip(x, places)], pa.list_(pa.float64())),
                        pa.array([0.0 if f else 1.0 for f in flips]),
                    ],
                    names=["size", "places", "values", "y"],
                )

    signed = both.mapInArrow(differences, "size int, places array<int>, values array<double>, y double")
    model = logistic(signed.select(_sparse("size", "places", "values").alias("x"), "y"), "x", "y", 2 * c, intercept=False, **COARSE)
    weights = model.coefficients.toArray()
    return lambda df: df.withColumn("score", features.margin(weights, seq, numbers)), weights


@dataclass(frozen=True)
class StoredKmers:
    """Features of ``KmerNumbers`` from a table that is written once: k-mers, unit length, scaled numbers.

    The k-mers of a text are the gaps between their sorted places, a byte each: what Python is sent
    is most of the time of a pass. 255 only adds to the next gap; a repeated k-mer has the gap 0.
    """

    kit: KmerNumbers

    @property
    def size(self) -> int:
        return len(self.kit.idf) + len(self.kit.mean)

    def store(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(y, gaps, unit, x) of rows (y, text, x)."""
        for part in (b.slice(i, WIDE_BLOCK) for b in batches for i in range(0, b.num_rows, WIDE_BLOCK)):
            texts, n = part.column("text").to_pylist(), part.num_rows
            row, place = np.divmod(np.sort(kmer_numbers(texts, self.kit.low, self.kit.high)), len(self.kit.idf))
            known = self.kit.idf[place] > 0
            row, place = row[known], place[known]
            many = np.bincount(row, minlength=n)
            gap = np.diff(place, prepend=0)
            first = (np.cumsum(many) - many)[many > 0]
            gap[first] = place[first]
            more, rest = np.divmod(gap, 255)
            ends = np.cumsum(more + 1)
            data = np.full(ends[-1] if len(ends) else 0, 255, dtype=np.uint8)
            data[ends - 1] = rest
            ends = np.append(0, ends)[np.append(0, np.cumsum(many))].astype(np.int32)
            row, _, value = self.kit.weighted(texts)
            length = np.sqrt(np.bincount(row, value * value, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("y"),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)]),
                    pa.array(np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)),
                    pa.array(list(self.kit.numbers(part.column("x").to_pylist())), pa.list_(pa.float64())),
                ],
                names=["y", "gaps", "unit", "x"],
            )

    def _open(self, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """How many k-mers each row has, their places and sublinear counts, next to the unit lengths and scaled numbers."""
        gaps = part.column("gaps").cast(pa.large_binary())
        ends = np.frombuffer(gaps.buffers()[1], np.int64, part.num_rows + 1, 8 * gaps.offset)
        gap = np.frombuffer(gaps.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends, last = ends - ends[0], gap < 255
        # Four bytes hold the places of a block, and are the cheaper ones to lay out.
        reached = np.append(np.int32(0), np.cumsum(gap, dtype=np.int32))
        starts = np.append(np.int32(0), np.cumsum(last, dtype=np.int32))[ends]
        place = reached[1:][last] - np.repeat(reached[ends[:-1]], np.diff(starts))
        new = np.append(True, place[1:] != place[:-1])[: len(place)]
        new[starts[:-1][np.diff(starts) > 0]] = True
        first = np.flatnonzero(new)
        many = np.diff(np.append(np.int32(0), np.cumsum(new, dtype=np.int32))[starts])
        x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        return many, place[first], sublinear(np.diff(first, append=len(place))), part.column("unit").to_numpy(), x

    def scores(self, part: pa.RecordBatch, *weights: np.ndarray) -> list[np.ndarray]:
        many, place, value, unit, x = self._open(part)
        some, kmers, out = many > 0, len(self.kit.idf), []
        first = (np.cumsum(many) - many)[some]
        for w in weights:
            total = np.zeros(len(many))
            if len(first):
                total[some] = np.add.reduceat(value * (self.kit.idf * w[:kmers])[place], first)
            out.append(total * unit + (x * w[kmers:]).sum(axis=1))
        return out

    def sums(self, part: pa.RecordBatch, by: np.ndarray, squared: bool = False) -> np.ndarray:
        many, place, value, unit, x = self._open(part)
        idf = self.kit.idf
        if squared:
            value, unit, x, idf = value**2, unit**2, x**2, idf**2
        return np.append(np.bincount(place, value * np.repeat(by * unit, many), minlength=len(idf)) * idf, by @ x)


def all_pairs_ranker(
    rows: DataFrame, label: str, numerics: Sequence[str], seq: str = "seq", c: float = 1.0, low: int = 3, high: int = 6
):
    """The ranker of ``pairwise_ranker`` on all pairs of a positive and a negative row. Returns a scoring function and the weights.

    Every row counts for the scales, the k-mers and the fit. All pairs together weigh as much as the larger class has
    rows: as if each of them met one row of the other class, but all rows of it in equal shares
    instead of a drawn one. Rows with a NULL label or number are left out. The rows are read three
    times; the passes of the fit read k-mers that are written once.
    """
    numbers = _numbers(numerics, None)
    used = rows.dropna(subset=[label, *numerics]).select(F.col(label).cast("int").alias("y"), F.col(seq).alias("text"), numbers.alias("x"))
    kit = _kmer_numbers(used, F.col("x"), "text", low, high)
    features, path = StoredKmers(kit), new_path(rows.sparkSession, "kmers")
    stored = used.mapInArrow(features.store, "y int, gaps binary, unit double, x array<double>")
    stored.write.parquet(path, compression="zstd")
    data = rows.sparkSession.read.parquet(path)
    weights = fit_all_pairs(data.coalesce(1 + data.count() // ROWS_PER_TASK), features, c, **COARSE)
    return lambda df: df.withColumn("score", kit.margin(weights, seq, numbers)), weights


Scorer = Callable[[pd.DataFrame], np.ndarray]


def score_rows(df: DataFrame, scorer: Scorer, columns: Sequence[str], name: str = "score") -> DataFrame:
    """Batches of rows through a user's scorer; one finite score per row, or an error."""
    used = list(columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.asarray(scorer(batch[used]), dtype=np.float64)
            if values.shape != (len(batch),):
                raise ValueError(f"scorer returned {values.shape} for {len(batch)} rows")
            if not np.isfinite(values).all():
                raise ValueError("scorer returned a non-finite score")
            yield batch.assign(**{name: values})

    return df.mapInPandas(run, schema)


def mine_hard_negatives(
    pool: DataFrame,
    scorer: Scorer,
    columns: Sequence[str],
    k: int,
    key: str = "id",
    sequence_hash: str = "sequence_hash",
    exclude: DataFrame | None = None,
) -> DataFrame:
    """The k best-scored negatives, one per sequence, without ids of earlier rounds.

    Excluded rows go before they are scored, and duplicates before the cut, so no slack
    for them is needed. Too few rows, or one without a sequence hash, are an error.
    """
    if not pool.filter(F.col(sequence_hash).isNull()).isEmpty():
        raise ValueError(f"rows without {sequence_hash} cannot be told apart")
    fresh = pool if exclude is None else pool.join(exclude.select(key), key, "left_anti")
    unique = best_per_sequence(score_rows(fresh, scorer, columns, "source_score"), sequence_hash, "source_score", key)
    best = cut(top_k(unique, k, ["-source_score", key]))
    if (found := best.count()) < k:
        raise ValueError(f"{k} hard negatives wanted, {found} left")
    return global_rank(best, ["-source_score", key], name="source_rank")
