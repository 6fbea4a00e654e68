"""Near duplicates among embeddings: int8 tile products with rigorous error bounds.

Equal vectors of a label are one class first. Classes are dealt into tiles of about
TILE rows, and every pair of tiles of a label is one task's work. There the unit
vectors are quantised to 8 bits, each with the exact length of what quantisation took
away; ``|x.y - x'.y'| <= |x-x'| + |x'| |y-y'|`` bounds the error of a product of
integers (exact in single precision). Only pairs that may reach the threshold within
that bound are computed again in double precision. A task counts links and sends on,
per row, its count and the smallest row it is joined to: never the pairs themselves.

Vectors that are NULL, empty, zero, or hold NULL or non-finite components, and those with
a NULL label or NULL vec_id, link with nothing. Vectors of different lengths do not link.
Repeated rows are vectors of their own that link with each other; rows with one vec_id and
other vectors are one node of the components. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import checked_columns, stored, table
from sitelab.llm.registry import query
from sitelab.operators.components import connected_components

TILE = 2048
ROWS = 256
#: Up to this length the sum of products of 8-bit integers is exact in single precision.
EXACT = 1040
#: Covers the rounding of the bound itself.
MARGIN = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to integers of -127..127, their scale, the length of the rest, the length of what stays."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    near = q * scale[:, None]
    kind = np.float32 if x.shape[1] <= EXACT else np.float64
    return q.astype(kind), scale, np.linalg.norm(x - near, axis=1), np.linalg.norm(near, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs with a cosine of ``threshold`` or more, and how many pairs were computed again.

    With ``y`` None the pairs i < j of ``x``.
    """
    same = y is None
    y = x if same else y
    xn, yn = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex, lx = quantised(x / xn[:, None])
    qy, sy, ey, _ = quantised(y / yn[:, None])
    left, right, again = [], [], 0
    for at in range(0, len(x), ROWS):
        part = slice(at, at + ROWS)
        product = (qx[part] @ qy.T).astype(float) * sx[part, None] * sy[None, :]
        bound = ex[part, None] + lx[part, None] * ey[None, :] + MARGIN
        i, j = np.nonzero(product + bound >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        again += len(i)
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            cosine = np.einsum("nd,nd->n", x[a], y[b]) / (xn[a] * yn[b])
            hit = cosine >= threshold
            left.append(a[hit])
            right.append(b[hit])
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), again


def _lowest(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Smallest ``order`` among the nodes joined to each node, by repeated minima over the links."""
    low = order.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if np.array_equal(before, low):
            return low


def _tile_pair(threshold: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        low, high = key[2], key[3]
        side = frame["tile"].to_numpy()
        ids, sizes = frame["rep"].to_numpy(), frame["size"].to_numpy()
        x = np.array(frame["embedding"].tolist(), dtype=float).reshape(len(frame), -1)
        if low == high:
            i, j, _ = tile_links(x, None, threshold)
        else:
            a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
            i, j, _ = tile_links(x[a], x[b], threshold) if len(a) and len(b) else (a[:0], b[:0], 0)
            i, j = a[i], b[j]
        links = np.bincount(i, sizes[j], len(frame)) + np.bincount(j, sizes[i], len(frame))
        root = _lowest(len(frame), i, j, ids)
        hit = links > 0
        return pd.DataFrame({"rep": ids[hit], "h1": frame["h1"].to_numpy()[hit], "links": links[hit].astype("int64"), "root": root[hit]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    rows = checked_columns(vectors, {"vec_id": "long", "embedding": "array<double>", "label": "int"})
    e = F.col("embedding")
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, number) & F.exists(e, lambda v: v != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    key = ["label", "dim", "h1", "h2"]
    keyed = rows.filter("sound").select(
        "vec_id", "embedding", "label", F.size(e).alias("dim"), F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(11), e).alias("h2")
    )
    classes = keyed.groupBy(*key).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min("embedding").alias("embedding")
    )
    classes = stored(classes, "near-classes")
    groups = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = classes.join(groups, ["label", "dim"]).withColumn("tile", F.pmod(F.hash("rep", "h1"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread = dealt.select("label", "dim", "rep", "h1", "size", "embedding", "tile", other.alias("other")).select(
        "label", "dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "rep", "h1", "size", "embedding", "tile"
    )
    found = spread.groupBy("label", "dim", "low", "high").applyInPandas(
        _tile_pair(threshold), "rep long, h1 long, links long, root long"
    )
    found = stored(found, "near-links")
    links = found.groupBy("rep", "h1").agg(F.sum("links").alias("links"))
    joined = connected_components(found.filter(F.col("rep") != F.col("root")).select("rep", "root"), "rep", "root")
    named = (
        classes.select(*key, "rep", "size")
        .join(links, ["rep", "h1"], "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            *key,
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = keyed.drop("embedding").join(named, key).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


_VALID = """
WITH sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.98
)
"""
SQL = (
    _VALID.replace("WITH sound", "WITH RECURSIVE sound", 1)
    + """, reach AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), lowest AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
counted AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.low, v.vec_id))::BIGINT AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.low, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN counted c ON v.vec_id = c.node LEFT JOIN lowest m ON v.vec_id = m.node
"""
)


@query("op1_near_dedup", SQL)
def op1(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
