"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelab.session import new_path

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, columns can be pruned.

    The files survive the loss of any executor and go when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that was read from them has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def checked_columns(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the named columns, cast to the wanted types; anything else in the input is ignored."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in needed.items()])


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and each whole row in ``_row``: helper columns cannot clash with those of the input."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(*names, row)


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows that ``packed`` put away; ``changed`` replaces columns that are there."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in columns])


#: What a row of documents is known by where a doc_id alone may be missing or repeated.
ROW_KEY = ("doc", "ta", "tb")


def row_key() -> list[Column]:
    """ROW_KEY from doc_id and text: doc_id with NULL last, and 128 bits of the text and of whether there is a doc_id."""
    told = F.col("doc_id").isNotNull()
    return [
        F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64("text", told).alias("ta"),
        F.xxhash64(F.lit(7), "text", told).alias("tb"),
    ]


def words(text: Column | str) -> Column:
    """Array of the words of a text; NULL gives an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column | str) -> Column:
    """Number of words without building them: word starts left after the runs are cut down."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Cut an Arrow batch into runs of rows with about ``most`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []
BLOCK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse; longer words than a block grow the table."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n, BLOCK) + 1
        up = np.full(size, _STEP, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words of one UTF-8 text, in order.

    A polynomial over random values of the bytes, taken for all words at once from
    running sums; blocks of about a megabyte bound the memory.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        s, e = starts[at:stop] - base, ends[at:stop] - base
        up, down = _powers(int(e[-1]))
        terms = _BYTES[raw[base : base + e[-1]]] * up[: e[-1]]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
        out[at:stop] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return out


def shingle_set(data: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words give one hash of the whole sequence."""
    h = word_hashes(data or b"", lower=True)
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    value = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        value = value * np.uint64(0xA24BAED4963EE407) + h[i : n - width + 1 + i]
    return np.unique(mixed(value))
