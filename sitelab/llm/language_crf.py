"""Language of texts by a linear-chain conditional random field over their words.

Every word has hashed features: its prefixes and suffixes, its character n-grams and the
word itself. Their weights, one per language, and the transitions between the languages
of neighbouring words are learned together, by gradient steps on the likelihood of
whole sequences; forward-backward gives each word a distribution over languages that
follows from all words around it, so short foreign passages are told apart from noise.
The language of a text is the one with the largest expected share of its words.

Labels are per document. Training sequences are made of runs of words from different
documents in turn, so that the transitions see switches. A run of the same rows gives
the same model: samples and runs are drawn by hashes.

``und`` is given where the text is NULL or has no letter, with score 0. Without labelled
documents everything is ``und``. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import checked_columns, stored, table, text_slices
from sitelab.llm.registry import query

BITS = 15
LENGTHS = (2, 3)
AFFIX = 3
#: Labelled documents used to fit at most, shared equally by the languages: the documented bound of the fit.
LABELLED = 2400
#: Tasks that sum gradients; each sends one vector of fixed size per step.
SUMMING = 8
STEPS = 24
RATE = 0.25
DECAY = 1e-4
RUN = (8, 48)
SEQUENCE = 256
#: Words of a padded block of sequences.
BLOCK = 400_000
REMEMBERED = 400_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _has_letter(found: list[str]) -> bool:
    """Some numerals count as word characters but are no letters."""
    return any(c.isalpha() for word in found for c in word)


def features(word: str) -> list[int]:
    """Hashed affixes, n-grams and the word; a prefix letter keeps the kinds apart."""
    bounded = f"<{word}>"
    found = {f"w{word}"}
    for k in range(1, min(AFFIX, len(word)) + 1):
        found.add(f"p{word[:k]}")
        found.add(f"s{word[-k:]}")
    for k in LENGTHS:
        found.update(f"g{bounded[i : i + k]}" for i in range(len(bounded) - k + 1))
    return sorted({zlib.crc32(f.encode()) >> (32 - BITS) for f in found})


def _emissions(weights: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """Summed weights per word, scaled by the root of the number of its features."""
    if not lists:
        return np.empty((0, weights.shape[1]), dtype=np.float32)
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=sizes.sum())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return (np.add.reduceat(weights[flat], starts, axis=0) / np.sqrt(sizes)[:, None]).astype(np.float32)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Word distributions, log-likelihood sum of the partition, and expected transitions.

    ``emit`` is (time, sequence, label) in logarithms, ``step`` the transition weights; places
    beyond the length of a sequence are ignored. Values are scaled at every place.
    """
    times, count, labels = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    move = np.exp(step)
    ahead = np.empty_like(e)
    scale = np.ones((times, count))
    live = np.arange(times)[:, None] < lengths[None, :]
    for t in range(times):
        now = e[t] if t == 0 else (ahead[t - 1] @ move) * e[t]
        total = now.sum(axis=1)
        scale[t] = total
        ahead[t] = now / total[:, None]
    back = np.ones((count, labels))
    marginal = np.empty_like(e)
    pairs = np.zeros((labels, labels))
    for t in range(times - 1, -1, -1):
        # Sequences that end here start with a neutral message.
        back = np.where((lengths - 1 == t)[:, None], 1.0, back)
        post = ahead[t] * back
        marginal[t] = post / post.sum(axis=1, keepdims=True)
        if t:
            message = e[t] * back
            use = live[t]
            joint_left, joint_right = ahead[t - 1][use], message[use] / scale[t][use][:, None]
            pairs += move * (joint_left.T @ joint_right)
            back = (message @ move.T) / scale[t][:, None]
    log_partition = float(((np.log(scale) + top[:, :, 0]) * live).sum())
    return marginal, log_partition, pairs


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences of similar length together, about BLOCK padded words each."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        width = max(1, BLOCK // int(lengths[order[at]]))
        yield order[at : at + width]
        at += width


def _padded(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, sequence) places in ``words`` of the chosen sequences; padding repeats a valid place."""
    n = lengths[chosen]
    times = np.arange(int(n.max()))[:, None]
    places = starts[chosen][None, :] + np.minimum(times, (n - 1)[None, :])
    return words[places], n


@dataclass
class Field:
    """A fitted model; ``known`` maps words to rows of ``table`` in a worker and is bounded."""

    labels: list[str]
    weights: np.ndarray
    step: np.ndarray
    known: dict = field(default_factory=dict, repr=False)
    rows: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "step": self.step, "known": {}, "rows": []}

    def look_up(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word of all texts, and the table of emissions."""
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, []
        known = self.known
        fresh = list(dict.fromkeys(w for text in found for w in text if w not in known))
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            for at in range(0, len(fresh), 50_000):
                self.rows.append(_emissions(self.weights, [features(w) for w in fresh[at : at + 50_000]]))
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        total = sum(map(len, found))
        words = np.fromiter((i for text in found for i in map(known.__getitem__, text)), dtype=np.int32, count=total)
        return words, self.rows[0] if self.rows else np.empty((0, len(self.labels)), dtype=np.float32)

    def label(self, texts: list[str | None], spans: bool = False) -> list[tuple[str, float, list | None]]:
        """(language, share, runs of (language, first word, end)) per text."""
        found = [letter_words(t) for t in texts]
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        words, rows = self.look_up(found)
        out: list = [(UNKNOWN, 0.0, [] if spans else None)] * len(texts)
        for chosen in _blocks(lengths):
            places, n = _padded(words, starts, lengths, chosen)
            marginal, _, _ = forward_backward(rows[places], n, self.step)
            live = np.arange(len(places))[:, None] < n[None, :]
            share = (marginal * live[:, :, None]).sum(axis=0) / n[:, None]
            for k, i in enumerate(chosen):
                if _has_letter(found[i][:64]) or _has_letter(found[i]):
                    best = int(share[k].argmax())
                    runs = _runs(marginal[: n[k], k].argmax(axis=1), self.labels) if spans else None
                    out[i] = (self.labels[best], float(min(1.0, share[k, best])), runs)
        return out


def _runs(best: np.ndarray, labels: list[str]) -> list[tuple[str, int, int]]:
    edges = np.flatnonzero(np.diff(best)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(best)]))
    return [(labels[best[s]], int(s), int(e)) for s, e in zip(starts, ends, strict=True)]


# Fitting


def _prepared(labels: list[str]):
    """One row per task: the distinct words' features, and sequences of runs from its documents in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(labels)}
        runs: list[tuple[int, int, list[str]]] = []
        for whole in batches:
            for batch in text_slices(whole):
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    words, at = letter_words(text), 0
                    draw = np.random.default_rng(zlib.crc32((text or "").encode()))
                    while at < len(words):
                        size = int(draw.integers(*RUN))
                        runs.append((int(draw.integers(1 << 62)), number[lang], words[at : at + size]))
                        at += size
        runs.sort(key=lambda r: (r[0], r[1], r[2]))
        known: dict[str, int] = {}
        words = np.array([known.setdefault(w, len(known)) for _, _, run_ in runs for w in run_], dtype=np.int32)
        truth = np.repeat([r[1] for r in runs], [len(r[2]) for r in runs]).astype(np.int8)
        lists = [features(w) for w in known]
        data = io.BytesIO()
        np.savez_compressed(
            data, words=words, truth=truth, sizes=np.array([len(x) for x in lists], dtype=np.int32),
            flat=np.array([i for x in lists for i in x], dtype=np.int32),
        )
        yield pa.RecordBatch.from_pydict({"data": pa.array([data.getvalue()], pa.binary())})

    return run


def _gradient(weights: np.ndarray, step: np.ndarray):
    """Likelihood and its derivative over the sequences of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = weights.shape[1]
        slope, moves, value, count = np.zeros(weights.shape), np.zeros(step.shape), 0.0, 0
        for batch in batches:
            for packed in batch.column("data").to_pylist():
                data = np.load(io.BytesIO(packed))
                words, truth, sizes, flat = (data[k] for k in ("words", "truth", "sizes", "flat"))
                if not len(words):
                    continue
                root = np.sqrt(sizes)[:, None]
                starts = np.cumsum(sizes) - sizes
                rows = np.add.reduceat(weights[flat], starts, axis=0) / root
                begin = np.arange(0, len(words), SEQUENCE)
                lengths = np.minimum(SEQUENCE, len(words) - begin)
                expected = np.zeros((len(sizes), labels))
                for chosen in _blocks(lengths):
                    places, n = _padded(np.arange(len(words)), begin, lengths, chosen)
                    marginal, total, pairs = forward_backward(rows[words[places]], n, step)
                    live = np.arange(len(places))[:, None] < n[None, :]
                    value -= total
                    moves -= pairs
                    hit = words[places][live]
                    for c in range(labels):
                        expected[:, c] += np.bincount(hit, marginal[:, :, c][live], len(sizes))
                seen = np.bincount(words.astype(np.int64) * labels + truth, minlength=len(sizes) * labels).reshape(-1, labels)
                value += float((rows * seen).sum())
                inner = np.ones(len(words), dtype=bool)
                inner[begin] = False
                at = np.flatnonzero(inner)
                told = np.bincount(truth[at - 1].astype(np.int64) * labels + truth[at], minlength=labels * labels)
                told = told.reshape(labels, labels)
                value += float((told * step).sum())
                moves += told
                by_word = (seen - expected) / root
                for c in range(labels):
                    slope[:, c] += np.bincount(flat, np.repeat(by_word[:, c], sizes), len(slope))
                count += len(words)
        yield pa.RecordBatch.from_pydict(
            {
                "value": pa.array([value]), "n": pa.array([count], pa.int64()),
                "slope": pa.array([slope.astype(np.float32).tobytes()], pa.binary()),
                "moves": pa.array([moves.tobytes()], pa.binary()),
            }
        )

    return run


def fit(docs: DataFrame, bound: int = LABELLED, steps: int = STEPS) -> Field | None:
    """A field from (doc_id, text, lang) rows; None if no row has both text and language.

    The driver holds the weights, whose number is fixed, and moves them by adaptive steps.
    """
    rows = checked_columns(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return None
    each = max(1, bound // len(labels))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, each / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1_000_000)) < share * 1_000_000
    drawn = rows.filter(draw).repartition(SUMMING, F.xxhash64("doc_id"))
    prepared = stored(drawn.select("text", "lang").mapInArrow(_prepared(labels), "data binary"), "crf-sequences")
    weights, step = np.zeros((1 << BITS, len(labels))), np.zeros((len(labels), len(labels)))
    speed = [(np.zeros_like(w), np.zeros_like(w)) for w in (weights, step)]
    kind = "value double, n long, slope binary, moves binary"
    for turn in range(1, steps + 1):
        parts = prepared.mapInArrow(_gradient(weights.astype(np.float32), step), kind).collect()
        n = max(1, sum(p["n"] for p in parts))
        slope = sum(np.frombuffer(p["slope"], dtype=np.float32).reshape(weights.shape) for p in parts) / n
        moves = sum(np.frombuffer(p["moves"]).reshape(step.shape) for p in parts) / n
        for value, gradient, (first, second) in zip((weights, step), (slope, moves), speed, strict=True):
            gradient = gradient - DECAY * value
            first += 0.1 * (gradient - first)
            second += 0.02 * (gradient * gradient - second)
            rise = (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.98**turn)) + 1e-8)
            value += RATE * rise / (1 + turn / 12)
    return Field(labels, weights.astype(np.float32), step)


def languages(docs: DataFrame, model: Field | None) -> DataFrame:
    """(doc_id, lang_pred, score, spans); spans are runs of words of one language."""
    rows = checked_columns(docs, {"doc_id": "long", "text": "string"})
    kind = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>"
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, most=16 << 20):
                texts = batch.column("text").to_pylist()
                found = model.label(texts, spans=True) if model else [(UNKNOWN, 0.0, [])] * len(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "lang_pred": pa.array([f[0] for f in found], pa.string()),
                        "score": pa.array([f[1] for f in found], pa.float64()),
                        "spans": pa.array([[{"lang": a, "start": s, "end": e} for a, s, e in f[2]] for f in found], span),
                    }
                )

    return rows.mapInArrow(run, kind)


def held_out(fold: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold)) == rest, F.lit(False))


@query("op2_language_id")
def op2(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return languages(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_runs")
    )
