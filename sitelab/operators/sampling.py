"""Deterministic draws: order by a hash of (seed, tag, key) instead of a random stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelab.operators.intervals import HALO_BIN, near_centres
from sitelab.operators.ordering import global_rank
from sitelab.session import cut

# The project seed and the per-epoch seed steps.
SEED = 20260721
NEGATIVE_STEP = 1009
POSITIVE_STEP = 7919
PERMUTATION_STEP = 88001

#: Hexadecimal digits of the hash that name a cell, and cells of a range.
CELL_DIGITS = 3
CELLS = 16**CELL_DIGITS

#: Rows beyond twice what is wanted that a greedy walk sees at first.
SLACK = 64


def draw_hash(tag: str | Column, key: str, seed: int = SEED) -> Column:
    """sha256 of ``seed|tag|key``."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), tag, F.col(key).cast("string")), 256)


def _hash_end(count: int, size: int) -> str:
    """A text below which about ``count`` of ``size`` hashes lie; above all of them if that is every row."""
    return "g" if count >= size else f"{count * 16**16 // size:016x}"


def _edge(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Per group the cell in which its ``_left``-th row lies, and how many rows of that cell are wanted.

    ``counts`` is (by..., cell, _left, _m) with at most CELLS cells a group.
    """
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_left", F.col("_left") - F.col("_upto") + F.col("_m"))
    return placed.filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_m"))).select(*by, cell, "_left")


def hash_cuts(hashed: DataFrame, quotas: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by..., _cut): hash and key of the ``n``-th row of each group that has more; ``hashed`` has the hash as ``_h``.

    The hash is uniform, so its leading digits cut a group into CELLS equal cells and the
    next ones each of them again. Only the cell at the edge is cut again, and only in the
    cell at the edge of that are rows ranked: of 10^11 rows about 6,000.
    """
    by = list(by)
    rows = hashed.select(*by, key, "_h")
    wanted = quotas.filter("n > 0").select(*by, F.col("n").alias("_left"))
    for level, cell in enumerate(("_c1", "_c2")):
        rows = rows.withColumn(cell, F.substring("_h", 1 + level * CELL_DIGITS, CELL_DIGITS))
        counts = rows.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("_m")).join(wanted, by)
        edge = _edge(counts, by, cell)
        rows = rows.join(edge.select(*by, cell), [*by, cell], "left_semi")
        wanted = edge.select(*by, "_left")
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key)))
    return ranked.join(wanted, by).filter("_rn = _left").select(*by, F.struct("_h", key).alias("_cut"))


def hash_sample(df: DataFrame, quotas: DataFrame, by: Sequence[str], key: str, tag: str | Column, seed: int = SEED) -> DataFrame:
    """Per group the ``n`` rows with the smallest hash; ``quotas`` is (by..., n)."""
    by = list(by)
    hashed = df.withColumn("_h", draw_hash(tag, key, seed))
    named = quotas.filter("n > 0").select(*by).join(hash_cuts(hashed, quotas, by, key), by, "left")
    # Groups without a cut have no more rows than wanted.
    inside = F.col("_cut").isNull() | (F.struct("_h", key) <= F.col("_cut"))
    return hashed.join(named, by).filter(inside).select(*df.columns)


def stable_sample(df: DataFrame, n: int, tag: str, key: str, seed: int = SEED) -> DataFrame:
    """n rows (or all) by hash order."""
    marked = df.withColumn("_all", F.lit(0))
    quota = df.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n).alias("n"))
    return hash_sample(marked, quota, ["_all"], key, tag, seed).drop("_all")


def draw(pool: DataFrame, count: int, tag: str, key: str, seed: int, repeat: bool = True) -> DataFrame:
    """``count`` rows with a slot 0..count-1; rows repeat only if allowed and the pool is smaller."""
    size = pool.count()
    if size == 0:
        raise ValueError("draw from an empty pool")
    if count > size and not repeat:
        raise ValueError(f"{count} distinct rows wanted, {size} available")
    # Only what is drawn is ranked.
    drawn = stable_sample(pool, min(count, size), tag, key, seed)
    ranked = global_rank(drawn.withColumn("_h", draw_hash(tag, key, seed)), ["_h", key], name="_r").drop("_h")
    if count <= size:
        return ranked.withColumn("slot", F.col("_r") - 1).drop("_r")
    slots = pool.sparkSession.range(count).select(F.col("id").alias("slot"), (F.col("id") % size + 1).alias("_r"))
    return slots.join(ranked, "_r").drop("_r").select(*pool.columns, "slot")


def shares(count: int) -> dict[str, int]:
    """20 / 40 / 40 of the mixed strategy; the last takes the remainder."""
    easy, matched = round(count * 0.20), round(count * 0.40)
    return {"easy": easy, "matched": matched, "hard": count - easy - matched}


def epoch_draw(
    pool: DataFrame, count: int, strategy: str, epoch: int, seed: int, key: str = "id", unique: bool = False
) -> DataFrame:
    """Negatives of one epoch from a pool with boolean matched / hard (/ guided) columns.

    ``unique`` gives the variant of the mixed strategy that draws an id once and
    fills up from the rest of the pool; a pool that is too small is an error.
    """
    number = seed + NEGATIVE_STEP * (epoch + 1)
    subset = {
        "random": F.lit(True),
        "matched": F.col("matched"),
        "hard": F.col("hard"),
        "easy": ~F.col("hard") & ~F.col("matched"),
    }
    if strategy == "guided":
        return draw(pool.filter("guided"), count, "guided", key, number)
    if strategy != "mixed":
        return draw(pool.filter(subset[strategy]), count, strategy, key, number)
    parts = [
        draw(pool.filter(subset[name]), n, name, key, number, repeat=not unique).drop("slot")
        for name, n in shares(count).items()
        if n > 0
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    if unique:
        chosen = cut(chosen.dropDuplicates([key]))
        missing = count - chosen.count()
        if missing > 0:
            rest = pool.join(chosen.select(key), key, "left_anti")
            chosen = chosen.unionByName(draw(rest, missing, "fill", key, number, repeat=False).drop("slot"))
    chosen = chosen.withColumn("_copy", F.monotonically_increasing_id()) if not unique else chosen
    shuffled = chosen.withColumn("_h", draw_hash("shuffle", key, number))
    order = ["_h", key] if unique else ["_h", key, "_copy"]
    ranked = global_rank(shuffled, order, name="_r")
    return ranked.select(*pool.columns, (F.col("_r") - 1).alias("slot"))


def rotating_slice(pool: DataFrame, count: int, epoch: int, key: str, seed: int) -> DataFrame:
    """Rows [epoch * count, (epoch + 1) * count) modulo the pool, of one fixed permutation.

    The slice lies between two cuts of the permutation, one part of it behind the other if
    it runs over the end; only its rows are ranked.
    """
    number = seed + PERMUTATION_STEP
    size = pool.count()
    if size == 0:
        return pool.withColumn("slot", F.lit(None).cast("bigint")).filter("false")
    first = (epoch * count) % size
    last = first + min(count, size)
    hashed = pool.withColumn("_h", draw_hash("permutation", key, number)).withColumn("_all", F.lit(0))
    spark = pool.sparkSession

    def upto(n: int) -> Column:
        """Whether a row is among the first n."""
        if n <= 0 or n >= size:
            return F.lit(n > 0)
        quota = spark.range(1).select(F.lit(0).alias("_all"), F.lit(n).alias("n"))
        found = hash_cuts(hashed, quota, ["_all"], key).first()["_cut"]
        return F.struct("_h", key) <= F.struct(F.lit(found[0]).alias("_h"), F.lit(found[1]).alias(key))

    wraps = last > size
    inside = (~upto(first)) | upto(last - size) if wraps else ~upto(first) & upto(last)
    ranked = global_rank(hashed.filter(inside).drop("_all"), ["_h", key], name="_r")
    # Of a slice that wraps, the rows of its second part have the smaller hashes.
    behind = last - size if wraps else 0
    slot = F.when(F.col("_r") <= behind, F.col("_r") - 1 + size - first).otherwise(F.col("_r") - 1 - behind)
    return ranked.withColumn("slot", slot).drop("_h", "_r")


def positive_schedule(positives: DataFrame, count: int, epoch: int, key: str, seed: int) -> DataFrame:
    """Positives repeated to ``count`` slots, shuffled by epoch."""
    number = seed + POSITIVE_STEP * (epoch + 1)
    size = positives.count()
    indexed = global_rank(positives, [key], name="_r")
    repeats = positives.sparkSession.range(count).select(
        F.col("id").alias("_i"), (F.col("id") % size + 1).alias("_r")
    )
    shuffled = repeats.withColumn("_h", draw_hash("positive", "_i", number))
    slots = global_rank(shuffled, ["_h", "_i"], name="_s").select("_r", (F.col("_s") - 1).alias("slot"))
    return slots.join(indexed, "_r").select(*positives.columns, "slot")


def ranking_pairs(
    positives: DataFrame, negatives: DataFrame, positive_key: str, negative_key: str
) -> DataFrame:
    """The i-th scheduled positive with the i-th drawn negative; an equi-join on the slot."""
    return positives.select("slot", F.col(positive_key).alias("positive_id")).join(
        negatives.select("slot", F.col(negative_key).alias("negative_id")), "slot"
    )


def train_sample(df: DataFrame, label: str, key: str, ratio: int, seed: int) -> DataFrame:
    """All positives and ``ratio`` negatives for each, without replacement."""
    positives = df.filter(F.col(label) == 1)
    wanted = ratio * positives.count()
    negatives = stable_sample(df.filter(F.col(label) == 0), wanted, "train_negative", key, seed + NEGATIVE_STEP)
    return positives.unionByName(negatives)


def largest_remainder(counts: DataFrame, stratum: Sequence[str], size: str, total: int) -> DataFrame:
    """Integer quotas proportional to ``size`` that add up to ``total``."""
    weight = counts.agg(F.sum(size).alias("w")).first()["w"]
    raw = F.lit(total) * F.col(size) / F.lit(weight)
    table = counts.select(
        *stratum, F.floor(raw).alias("_base"), (raw - F.floor(raw)).alias("_rest")
    )
    given = table.agg(F.sum("_base").alias("g")).first()["g"]
    ranked = global_rank(table, ["-_rest", *[f"-{c}" for c in stratum]], name="_r")
    return ranked.select(
        *stratum, (F.col("_base") + (F.col("_r") <= total - given).cast("bigint")).alias("n")
    )


def thin(
    df: DataFrame, key: str, chrom: str, position: str, sequence: str, distance: int, seed: int, order: Column | None = None
) -> DataFrame:
    """Greedy thinning in hash order: no two kept rows near each other or of equal sequence.

    ``order`` is a text that differs for every row and comes instead of the hash.

    Each round keeps the rows that come first among all rows still alive in their
    neighbourhood and in their sequence group, and drops what conflicts with
    them; the result is that of the sequential greedy. A round aggregates to one
    row per position and per sequence, so conflicts are never listed as pairs.
    """
    prefix = [chrom, position]
    alive = cut(
        df.select(
            key, *prefix, F.sha2(sequence, 256).alias("_seq"),
            (draw_hash("thin", key, seed) if order is None else order).alias("_first"),
        )
    )
    kept = None
    width = max(HALO_BIN, distance)
    while (rows := alive.count()) > 0:
        by_sequence = alive.groupBy("_seq").agg(F.min("_first").alias("_first"), F.count(F.lit(1)).alias("_n"))
        best = F.min(F.struct("_first", key, "_seq"))
        by_position = alive.groupBy(*prefix).agg(best.alias("_b"), F.count(F.lit(1)).alias("_n"))
        reach = F.sequence(
            F.floor((F.col(position) - distance) / width), F.floor((F.col(position) + distance) / width)
        )
        w = Window.partitionBy(chrom, "_stretch").orderBy(position).rangeBetween(-distance, distance)
        local = (
            by_position.withColumn("_stretch", F.explode(reach))
            .withColumn("_around", F.min("_b._first").over(w))
            .filter((F.col("_stretch") == F.floor(F.col(position) / width)) & (F.col("_around") == F.col("_b._first")))
            .select(*prefix, "_b.*")
        )
        # The hash is unique, so this join is one-to-one even for a popular sequence.
        won = cut(local.join(by_sequence.select("_seq", "_first"), ["_seq", "_first"]).select(key, *prefix, "_seq"))
        kept = won.select(key) if kept is None else kept.unionByName(won.select(key))
        close = near_centres(by_position.select(*prefix), won, [chrom], position, distance)
        blocked = by_position.select(*prefix, "_n").join(close.withColumn("_near", F.lit(True)), prefix)
        used = by_sequence.select("_seq", "_n").join(won.select("_seq", F.lit(True).alias("_used")), "_seq")
        left = alive.join(blocked, prefix, "left").filter(F.col("_near").isNull()).drop("_near", "_n")
        left = left.join(used, "_seq", "left").filter(F.col("_used").isNull()).drop("_used", "_n")
        alive = cut(left)
    kept = cut(kept) if kept is not None else alive.select(key)
    return df.join(kept, key, "left_semi")


def without_conflicts(df: DataFrame, taken: DataFrame, chrom: str, position: str, sequence: str, distance: int) -> DataFrame:
    """Rows of ``df`` that are neither near a row of ``taken`` nor of its sequence."""
    prefix = [chrom, position]
    near = near_centres(df.select(*prefix).distinct(), taken.select(*prefix), [chrom], position, distance)
    apart = df.join(near, prefix, "left_anti")
    used = taken.select(F.sha2(sequence, 256).alias("_seq")).distinct()
    return apart.withColumn("_seq", F.sha2(sequence, 256)).join(used, "_seq", "left_anti").select(*df.columns)


def thin_to_quotas(
    df: DataFrame,
    key: str,
    chrom: str,
    position: str,
    sequence: str,
    distance: int,
    stratum: Sequence[str],
    quotas: DataFrame,
    total: int,
    seed: int,
) -> DataFrame:
    """``total`` rows without conflicts: stratum by stratum up to its quota, then from what is left.

    The result is that of one walk: strata in order, in each the rows by hash, a row taken
    if it conflicts with none taken so far, until the quota is full; then all other rows by
    another hash until ``total`` is full. Rows behind a full quota never block others.

    The walk is found as a fixpoint of one cut per stratum, the hash of the row that fills
    the quota. Each round thins the rows up to the cuts in the walk's order and reads the
    cuts off again; a stratum that its cut leaves short is opened. Rounds end when no cut
    moves, then every row stands as in the walk, since its decision follows from earlier
    ones only. The cuts are as many as the strata. Fewer than ``total`` rows are an error.

    A walk sees rows in hash order, so those behind the last one taken cannot matter: a
    stratum shows its first rows only, some more than its quota, and four times as many
    whenever they leave it short; so does the refill.
    """
    place = F.concat_ws("|", *[F.coalesce(F.lpad(F.col(c).cast("string"), 12, "0"), F.lit("")) for c in stratum])
    own = [key, chrom, position, sequence]
    rows = df.select(*own, place.alias("_stratum"), draw_hash("thin", key, seed).alias("_h"))
    wanted = {r["_stratum"]: r["n"] for r in quotas.filter("n > 0").select(place.alias("_stratum"), "n").collect()}
    sizes = {r["_stratum"]: r["n"] for r in rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown = {s: 2 * q + SLACK for s, q in wanted.items() if s in sizes}
    spark, cuts, first = df.sparkSession, {}, None
    while shown:
        if first is None:
            ends = spark.createDataFrame(
                [(s, wanted[s], _hash_end(n, sizes[s])) for s, n in shown.items()], "_stratum string, _quota long, _end string"
            )
            first = cut(rows.join(ends, "_stratum").filter(F.col("_h") < F.col("_end")).drop("_end"))
        table = spark.createDataFrame(list(cuts.items()), "_stratum string, _cut string")
        open_ = first.join(table, "_stratum", "left").filter(F.col("_cut").isNull() | (F.col("_h") <= F.col("_cut"))).drop("_cut")
        kept = thin(open_, key, chrom, position, sequence, distance, seed, F.concat_ws("|", "_stratum", "_h"))
        ranked = cut(global_rank(kept, ["_h", key], by=["_stratum"], name="_r"))
        found = ranked.groupBy("_stratum").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_r") == F.col("_quota"), F.col("_h"))).alias("h")
        )
        moved = {r["_stratum"]: r["h"] for r in found.collect() if r["n"] >= wanted[r["_stratum"]]}
        # Short without a cut: its first rows were too few.
        if more := [s for s in shown if s not in moved and s not in cuts and shown[s] < sizes[s]]:
            shown |= {s: 4 * shown[s] for s in more}
            first = None
        elif moved == cuts:
            break
        cuts = moved
    chosen = cut(ranked.filter(F.col("_r") <= F.col("_quota")).select(*own) if shown else df.select(*own).limit(0))
    missing = total - chosen.count()
    keys = chosen.select(key)
    if missing > 0:
        everything = sum(sizes.values())
        count = 2 * missing + SLACK
        while True:
            early = cut(df.select(*own).withColumn("_f", draw_hash("fill", key, seed)).filter(F.col("_f") < _hash_end(count, everything)))
            rest = without_conflicts(early.join(keys, key, "left_anti"), chosen, chrom, position, sequence, distance)
            more = thin(rest, key, chrom, position, sequence, distance, seed, F.col("_f"))
            filled = cut(stable_sample(more.select(key), missing, "fill", key, seed))
            short = missing - filled.count()
            if short <= 0 or count >= everything:
                break
            count *= 4
        if short > 0:
            raise ValueError(f"{total} rows wanted, {total - short} available")
        keys = keys.unionByName(filled)
    # Under a name of its own: Spark loses track of a checkpointed column that it has to rename within a union.
    return df.join(keys.select(F.col(key).alias("_chosen")), F.col(key) == F.col("_chosen"), "left_semi")
