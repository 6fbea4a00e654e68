"""Mixing sources to target weights by entropy balancing.

The rates are the closest to 1, in relative entropy over documents, among all rates
of 0 to ``cap`` that give every source its target of words. The convex dual has one
multiplier per source; its solution tilts exponentially by size:
``rate = min(cap, exp(multiplier * size / mean size of the source))``. Newton steps
find all multipliers together, one aggregation a step over the (source, size) counts.
The rates are then rounded into whole copies along the sizes of each source, and what
rounding leaves is made up by the best fitting sizes.

Nulls: a NULL text has size 0 and is never taken; NULL is a source of its own and
comes last. Repeated rows are documents of their own. An empty table gives no rows.
Extra columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelab.llm.common import n_words, packed, stored, table, unpacked
from sitelab.llm.registry import query
from sitelab.operators.ordering import Ordered, Scan, global_rank

#: Documents of one source and size that are ranked together when copies are dealt out.
CELL = 512
#: Relative error of a source's words at which a multiplier counts as found.
TOLERANCE = 1e-7
STEPS = 80
REPAIRS = 4


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size, n_docs) to the same with sid and target.

    Sources in code-point order, NULL last, weigh ``weights`` in turn and share
    ``share`` of all sizes; none gets over ``cap`` times its size, and what it cannot
    take goes to the others by weight. The water level is exact: below it a source
    gets level * weight, above it its cap.
    """
    keyed = sources.withColumn("_last", F.col("source").isNull())
    ranked = global_rank(keyed, ["_last", "source"], name="sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_full", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("_edge", F.col("_full") / F.col("_w"))
    scanned = (
        Ordered(ranked, ["_edge", "sid"])
        .scan(
            _filled=Scan("sum", "_full", exclusive=True),
            _open=Scan("sum", "_w", reverse=True),
            _all=Scan("sum", F.col("source_size").cast("double"), whole=True),
        )
        .with_column("_level", (F.col("_all") * F.lit(float(share)) - F.col("_filled")) / F.col("_open"))
        .with_column("_level", F.when(F.col("_level") <= F.col("_edge"), F.col("_level")))
        .scan(_water=Scan("max", "_level", whole=True))
        .frame()
    )
    target = F.when(F.col("_water").isNull() | (F.col("_edge") <= F.col("_water")), F.col("_full")).otherwise(
        F.col("_water") * F.col("_w")
    )
    return scanned.select("sid", "source", "source_size", "n_docs", target.alias("target"))


def tilt(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    # exp of a large number is infinite, and the smaller of it and the cap is the cap.
    return F.least(F.lit(float(cap)), F.exp(multiplier * size / mean))


def balance(counts: DataFrame, cap: float = 2.0) -> DataFrame:
    """(sid, size, n, source_size, n_docs, target) to (sid, multiplier, error, words).

    The derivative of the dual grows in the multiplier, so a Newton step that leaves
    the bracket found so far is replaced by its middle (or by a doubling, as long as
    one side is open); every step is one aggregation for all sources.
    """
    live = counts.filter(
        (F.col("size") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(cap)))
    ).withColumn("_mean", F.col("source_size") / F.col("n_docs"))
    live = stored(live, "mix-live")
    no_bound = F.lit(None).cast("double")
    state = stored(
        live.select("sid").distinct().select(
            "sid", F.lit(0.0).alias("multiplier"), no_bound.alias("low"), no_bound.alias("high")
        ),
        "mix-state",
    )
    for _ in range(STEPS):
        rate = tilt(F.col("multiplier"), F.col("size"), F.col("_mean"), cap)
        words = F.col("n") * F.col("size") * rate
        sums = live.join(state, "sid").groupBy("sid").agg(
            F.sum(words).alias("words"),
            F.sum(F.when(rate < cap, words * F.col("size") / F.col("_mean")).otherwise(0.0)).alias("slope"),
            *[F.first(c).alias(c) for c in ("target", "multiplier", "low", "high")],
        )
        short = F.col("words") < F.col("target")
        at = F.col("multiplier")
        found = sums.select(
            "sid",
            at.alias("at"),
            (F.abs(F.col("words") - F.col("target")) / F.col("target")).alias("error"),
            F.when(F.col("slope") > 0, at - (F.col("words") - F.col("target")) / F.col("slope")).alias("newton"),
            F.when(short, at).otherwise(F.col("low")).alias("low"),
            F.when(short, F.col("high")).otherwise(at).alias("high"),
        )
        inside = (
            F.col("newton").isNotNull()
            & (F.col("low").isNull() | (F.col("newton") > F.col("low")))
            & (F.col("high").isNull() | (F.col("newton") < F.col("high")))
            & (F.abs(F.col("newton")) <= 4 * F.abs(F.col("at")) + 4)
        )
        wide = F.abs(F.col("at")) * 2 + 1
        other = (
            F.when(F.col("high").isNull(), F.col("low") + wide)
            .when(F.col("low").isNull(), F.col("high") - wide)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        settled = F.col("error") <= TOLERANCE
        state = stored(
            found.select(
                "sid",
                F.when(settled, F.col("at")).when(inside, F.col("newton")).otherwise(other).alias("multiplier"),
                "low",
                "high",
                "error",
            ),
            "mix-state",
        )
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"a source is still off its target after {STEPS} steps")
    return state.select("sid", "multiplier")


def _rates(counts: DataFrame, cap: float) -> DataFrame:
    found = balance(counts, cap)
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap))
    mean = F.col("source_size") / F.col("n_docs")
    rate = (
        F.when((F.col("size") == 0) | (F.col("target") <= 0), F.lit(0.0))
        .when(full, F.lit(float(cap)))
        .otherwise(tilt(F.col("multiplier"), F.col("size"), mean, cap))
    )
    return counts.join(found, "sid", "left").withColumn("rate", rate).drop("multiplier")


def _copies_of_cells(cells: DataFrame, cap: int) -> DataFrame:
    """Total copies per (sid, size, cell), summing to the rates within half a copy along the sizes."""
    shares = cells.withColumn("_part", F.col("m") * F.col("rate"))
    lined = Ordered(shares, ["-size", "cell"], ["sid"]).scan(_upto=Scan("sum", "_part")).frame()
    whole = F.floor(F.col("_upto") + 0.5) - F.floor(F.col("_upto") - F.col("_part") + 0.5)
    lined = lined.withColumn("copies", F.greatest(F.lit(0), F.least(whole, F.col("m") * cap)).cast("long"))
    lined = stored(lined.select("sid", "size", "cell", "m", "target", "rate", "copies"), "mix-cells")
    for _ in range(REPAIRS):
        left = lined.groupBy("sid").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_left"))
        options = lined.filter(F.col("size") > 0).join(left, "sid")
        room = F.when(F.col("_left") > 0, F.col("m") * cap - F.col("copies")).otherwise(F.col("copies"))
        steps = F.least(room, F.floor(F.abs(F.col("_left")) / F.col("size") + 0.5))
        after = F.abs(F.abs(F.col("_left")) - F.col("_steps") * F.col("size"))
        best = (
            options.withColumn("_steps", steps)
            .filter((F.col("_steps") > 0) & (after < F.abs(F.col("_left"))))
            .groupBy("sid")
            .agg(
                F.min(
                    F.struct(
                        after.alias("after"),
                        "size",
                        "cell",
                        (F.col("_steps") * F.signum("_left")).cast("long").alias("add"),
                    )
                ).alias("_best")
            )
            .select("sid", F.col("_best.size").alias("size"), F.col("_best.cell").alias("cell"), F.col("_best.add").alias("_add"))
        )
        lined = stored(
            lined.join(best, ["sid", "size", "cell"], "left")
            .withColumn("copies", F.col("copies") + F.coalesce("_add", F.lit(0)))
            .drop("_add"),
            "mix-cells",
        )
    return lined


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, size: Column | None = None
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    A document of hash rank r among those of its source and size gets the whole part of
    their mean copies, and one more if r is within the rest; a run over the same rows
    gives the same copies however they are partitioned. Rows with a NULL or a repeated
    doc_id are ranked by their text.
    """
    return _dealt(docs, weights, share, cap, size).drop("who", "turn")


def _who() -> Column:
    """What tells apart documents of one source and size: rows with a NULL or a repeated doc_id differ by their text."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull())


def _dealt(docs: DataFrame, weights: Sequence[float], share: float, cap: int, size: Column | None) -> DataFrame:
    """The rows of ``mix`` with ``who``, and ``turn`` from 1 among rows with one doc_id, source and text.

    Equal rows are counted before they are ranked, so they take one place of a cell however
    many they are; documents without words are never ranked.
    """
    size = n_words("text") if size is None else size
    sized = stored(docs.select("doc_id", "source", size.alias("size"), _who().alias("who")), "mix-sized")
    counts = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sources = counts.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    targets = source_targets(sources, weights, share, cap).withColumnRenamed("source", "_source")
    counts = stored(
        counts.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-targets"
    )
    rated = _rates(counts, float(cap)).withColumnRenamed("source", "_source").withColumnRenamed("size", "_size")
    cell = F.pmod(F.xxhash64("who", F.lit("cell")), F.ceil(F.col("n") / CELL)).cast("int")
    out = ["doc_id", "source", "size", "source_size", "target", "rate"]
    joined = sized.join(rated, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    placed = stored(joined.withColumn("cell", cell).select(*out, "sid", "cell", "who"), "mix-placed")
    keys = ["sid", "size", "cell"]
    ranked = placed.filter(F.col("size") > 0)
    cells = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.first("target").alias("target"), F.first("rate").alias("rate"))
    plan = _copies_of_cells(cells, cap).select(*keys, "m", F.col("copies").alias("_total"))
    equal = ranked.groupBy(*keys, "doc_id", "source", "who").agg(
        F.count(F.lit(1)).alias("_equal"), *[F.first(c).alias(c) for c in ("source_size", "target", "rate")]
    )
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("who", F.lit("rank")), "who", "doc_id")
    before = F.sum("_equal").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_equal")
    each = F.floor(F.col("_total") / F.col("m"))
    more = F.col("_total") - each * F.col("m") - F.col("_before")
    taken = (
        equal.withColumn("_before", before)
        .join(plan, keys)
        .select(*out, "who", each.alias("_each"), more.alias("_more"), F.explode(F.sequence(F.lit(1).cast("long"), "_equal")).alias("turn"))
        .withColumn("copies", (F.col("_each") + (F.col("turn") <= F.col("_more")).cast("long")).cast("long"))
        .drop("_each", "_more")
    )
    nothing = placed.filter(F.col("size") == 0).select(
        *out, "who", F.lit(1).cast("long").alias("turn"), F.lit(0).cast("long").alias("copies")
    )
    both = taken.unionByName(nothing)
    return both.select(*out, "copies", (F.col("copies") * F.col("size")).alias("taken"), "who", "turn")


PLAIN_KEYS = ("_who", "_doc", "_no_doc", "_source", "_no_source")


def _plain_keys(who: Column) -> list[Column]:
    """PLAIN_KEYS: doc_id, source and ``who`` as columns without NULL, which a join and a window can share."""
    doc, source = F.col("doc_id"), F.col("source")
    return [
        who.alias("_who"), F.coalesce(doc.cast("string"), F.lit("")).alias("_doc"), doc.isNull().alias("_no_doc"),
        F.coalesce(source, F.lit("")).alias("_source"), source.isNull().alias("_no_source"),
    ]


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, size: Column | None = None
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows with one doc_id, source and text are numbered together; all others meet the plan by their key alone.
    """
    plan = _dealt(docs, weights, share, cap, size).groupBy(*_plain_keys(F.col("who"))).agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    # Equal rows differ by one copy at most, the first of them take more.
    each = F.floor(F.col("_sum") / F.col("_n"))
    plan = plan.filter(F.col("_sum") > 0).withColumn("_each", each).withColumn("_more", F.col("_sum") - F.col("_each") * F.col("_n"))
    rows = packed(docs, *_plain_keys(_who()))
    # The join and the numbers need the same placement, so that texts are shuffled once.
    turn = F.row_number().over(Window.partitionBy(*PLAIN_KEYS).orderBy("_who"))
    taken = rows.join(plan, list(PLAIN_KEYS)).withColumn("_copies", F.col("_each") + (turn <= F.col("_more")).cast("long"))
    taken = taken.filter(F.col("_copies") > 0).select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return unpacked(taken, docs.columns)


@query("op6_mixing")
def op6(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )
