"""Group-atomic splits, fixed evaluation sets, folds, and pool flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelab.functions.scoring import efficiency_bin, gc_bin, region_class
from sitelab.operators.ordering import Ordered, Scan, global_rank
from sitelab.operators.sampling import SEED, draw_hash, hash_sample, stable_sample
from sitelab.session import cut

# Split names and shares, in percent, in the order in which an axis is cut.
PERCENT = {"train": 70, "dev": 10, "calibration": 10, "test": 10}
#: A group belongs to the first tier whose share its largest feature share reaches ...
TIERS = (1 / 4, 1 / 16, 1 / 64)
#: ... and else to a wave by its hash: half of the rest, a quarter, an eighth, and two sixteenths.
WAVES = ("8", "c", "e", "f")


def _features() -> list[Column]:
    """What a row adds to its group: a row, and for a positive one also its class and its profile."""
    profile = {
        "chrom": F.col("chrom"),
        "region": region_class("region"),
        "gc": gc_bin("gc").cast("string"),
        "efficiency": efficiency_bin("efficiency").cast("string"),
    }
    positive = [F.lit("positive"), *[F.concat(F.lit(f"{name}:"), F.coalesce(v, F.lit("NA"))) for name, v in profile.items()]]
    return [F.lit("total"), *[F.when(F.col("label") == 1, v) for v in positive]]


def group_features(sites: DataFrame, group: str) -> DataFrame:
    """(group, feature, c): how much of each feature a group holds."""
    each = sites.select(group, F.explode(F.array(*_features())).alias("feature")).filter(F.col("feature").isNotNull())
    return each.groupBy(group, "feature").agg(F.count(F.lit(1)).alias("c"))


def _tier(share: Column, digest: Column) -> Column:
    chosen = None
    for i, least in enumerate(TIERS):
        chosen = F.when(share >= least, i) if chosen is None else chosen.when(share >= least, i)
    for i, below in enumerate(WAVES):
        chosen = chosen.when(digest < below, len(TIERS) + i)
    return chosen.otherwise(len(TIERS) + len(WAVES))


def _imbalance(totals: DataFrame, filled: DataFrame) -> DataFrame:
    """(feature, t, had, off): what the splits hold of each feature, and how far that is from their shares of it."""
    had = totals.join(filled.groupBy("feature").pivot("split", list(PERCENT)).agg(F.sum("n")), "feature", "left")
    had = had.select("feature", "t", F.array(*[F.coalesce(F.col(name), F.lit(0)) for name in PERCENT]).alias("had"))
    whole = sum(F.get("had", F.lit(i)) for i in range(len(PERCENT)))
    miss = [F.abs(F.get("had", F.lit(i)) * 100 - whole * pct) for i, pct in enumerate(PERCENT.values())]
    return had.withColumn("off", F.greatest(*miss) / F.col("t"))


def _edges(balance: DataFrame, part: DataFrame) -> DataFrame:
    """(lead, edges): per feature where an axis of 0 to 1 is cut, by what each split still lacks.

    Of what a split lacks, its share of the feature in groups led by other features comes by itself.
    """
    others = part.filter(F.col("feature") != F.col("lead")).groupBy("feature").agg(F.sum("c").alias("o"))
    lacks = [
        F.greatest(F.lit(0), F.col("t") * pct - F.get("had", F.lit(i)) * 100 - F.coalesce("o", F.lit(0)) * pct)
        for i, pct in enumerate(PERCENT.values())
    ]
    rooms = balance.join(others, "feature", "left").select(F.col("feature").alias("lead"), *[v.alias(f"_{i}") for i, v in enumerate(lacks)])
    whole = sum(F.col(f"_{i}") for i in range(len(PERCENT)))
    fallback, edges = 0, []
    for i, pct in enumerate(PERCENT.values()):
        fallback += pct
        upto = sum(F.col(f"_{k}") for k in range(i + 1))
        edges.append(F.when(whole > 0, upto / whole).otherwise(fallback / 100))
    return rooms.select("lead", F.array(*edges).alias("edges"))


def split_groups(sites: DataFrame, group: str, seed: int = SEED) -> DataFrame:
    """(group, split) with whole groups in one split, about 70/10/10/10 of every feature.

    One rule for all groups. The features are rows, positives, and among positives each
    chromosome, region class, GC bin and efficiency bin. Groups that hold about as much
    are dealt together: large shares first (``TIERS``), the many small ones in waves by
    hash. In each pass a group is led by that of its features which the splits hold most
    unevenly so far, of equal ones that of which it holds the largest share. The groups
    that one feature leads lie along an axis in hash order, each as long as what it holds;
    the axis is cut in proportion to what each split still lacks of that feature, and a
    group goes where its middle lies. What a pass leaves uneven, the next ones even out.
    Tiers hold at most 64 groups a feature; the waves use running totals over a range
    layout. ``sites`` has label, chrom, region, gc and efficiency; a NULL feature value
    counts as ``NA``.
    """
    held = group_features(sites, group)
    totals = cut(held.groupBy("feature").agg(F.sum("c").alias("t")))
    shared = held.join(totals, "feature").select(group, "feature", "c", (F.col("c") / F.col("t")).alias("share"))
    digest = draw_hash("split", group, seed)
    tiers = shared.groupBy(group).agg(F.max("share").alias("share")).select(group, digest.alias("_h"), _tier(F.col("share"), digest).alias("_tier"))
    held = cut(shared.join(tiers, group))
    filled = sites.sparkSession.createDataFrame([], "feature string, split string, n long")
    placed = tiers.select(group, F.lit(None).cast("string").alias("split")).filter("false")
    for tier in sorted(r["_tier"] for r in held.select("_tier").distinct().collect()):
        balance = cut(_imbalance(totals, filled))
        part = held.filter(F.col("_tier") == tier).join(balance.select("feature", "off"), "feature")
        leads = part.groupBy(group).agg(F.max(F.struct("off", "share", "feature")).alias("_m")).select(group, F.col("_m.feature").alias("lead"))
        part = cut(part.join(leads, group))
        own = part.filter(F.col("feature") == F.col("lead")).select(group, "lead", "c", "_h")
        if tier < len(TIERS):
            across = Window.partitionBy("lead")
            before = across.orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)
            laid = own.select("*", F.sum("c").over(before).alias("_before"), F.sum("c").over(across).alias("_whole"))
        else:
            scans = {"_before": Scan("sum", "c", exclusive=True), "_whole": Scan("sum", "c", whole=True)}
            laid = Ordered(own, ["_h", group], ["lead"]).scan(**scans).frame()
        middle = (F.coalesce("_before", F.lit(0)) * 2 + F.col("c")) / (F.col("_whole") * 2)
        turn = F.size(F.filter("edges", lambda edge: edge <= F.col("_middle")))
        names = F.array(*map(F.lit, PERCENT))
        dealt = laid.withColumn("_middle", middle).join(_edges(balance, part), "lead")
        dealt = cut(dealt.select(group, F.get(names, F.least(turn, F.lit(len(PERCENT) - 1))).alias("split")))
        more = part.join(dealt, group).groupBy("feature", "split").agg(F.sum("c").alias("n"))
        filled = cut(filled.unionByName(more).groupBy("feature", "split").agg(F.sum("n").alias("n")))
        placed = placed.unionByName(dealt)
    return placed


def assign_splits(sites: DataFrame, groups: DataFrame, placed: DataFrame, key: str, group: str) -> DataFrame:
    """Site rows with their group, group size and split."""
    small = placed.join(groups.select(group, "group_size").distinct(), group)
    by_group = groups.drop("group_size").join(small, group)
    return sites.join(by_group, key)


def centre_kmer_hard(negatives: DataFrame, positives: DataFrame, kmer: str) -> DataFrame:
    """Flag ``hard``: the centre k-mer occurs among the positives (at most 4**k values)."""
    seen = positives.select(kmer).distinct().withColumn("_seen", F.lit(True))
    return negatives.join(seen, kmer, "left").withColumn("hard", F.col("_seen").isNotNull()).drop("_seen")


def stratum_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def matched_strata(negatives: DataFrame, positives: DataFrame, stratum: Sequence[str]) -> DataFrame:
    """Flag ``matched`` and the stratum as text: the stratum occurs among the positives."""
    seen = (
        positives.select(stratum_text(stratum).alias("matching_stratum"))
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    marked = negatives.withColumn("matching_stratum", stratum_text(stratum))
    joined = marked.join(seen, "matching_stratum", "left")
    return joined.select(*negatives.columns, "matching_stratum", F.col("_seen").isNotNull().alias("matched"))


def ratio_set(
    sites: DataFrame, split: str, ratio: int, key: str, fit_positives: bool, seed: int = SEED, name: str | None = None
) -> DataFrame:
    """A set of one split with ``ratio`` negatives per positive.

    With ``fit_positives`` the positives shrink until the ratio is exact; without,
    all positives stay and the negatives may run short. A ratio that leaves nothing is an error.
    """
    rows = sites.filter(F.col("split") == split)
    labels = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
    if fit_positives and not min(labels["p"], labels["q"] // ratio):
        raise ValueError(f"{split}: {labels['p']} positives and {labels['q']} negatives give no set of 1 to {ratio}")
    counts = rows.groupBy("split").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")
    )
    used = F.least(F.col("p"), F.floor(F.col("q") / ratio)) if fit_positives else F.col("p")
    both = F.array(
        F.struct(F.lit(1).alias("label"), used.cast("bigint").alias("n")),
        F.struct(F.lit(0).alias("label"), (used * ratio).cast("bigint").alias("n")),
    )
    quotas = counts.select("split", F.inline(both))
    if fit_positives:
        tag = F.when(F.col("label") == 1, f"{split}_positive").otherwise(f"{split}_negative")
    else:
        tag = F.lit(name or f"{split}_1to{ratio}")
    return hash_sample(rows, quotas, ["split", "label"], key, tag, seed)


def hard_set(
    sites: DataFrame, split: str, ratio: int, key: str, kmer: str, floor: int = 1000, seed: int = SEED
) -> DataFrame:
    """Negatives of a split that share a centre k-mer with a training positive; none at all is an error."""
    pool = sites.filter((F.col("split") == split) & (F.col("label") == 0))
    train = sites.filter((F.col("split") == "train") & (F.col("label") == 1))
    hard = centre_kmer_hard(pool, train, kmer).filter("hard").drop("hard")
    positives = sites.filter((F.col("split") == split) & (F.col("label") == 1)).count()
    if not (available := hard.count()):
        raise ValueError(f"{split}: no negative shares a centre k-mer with a training positive")
    wanted = max(positives * ratio, min(floor, available))
    return stable_sample(hard.select(*sites.columns), wanted, f"{split}_hard", key, seed)


def grouped_folds(df: DataFrame, label: str, group: str, folds: int, seed: int) -> DataFrame:
    """Fold 0..folds-1 per group: whole groups, positives and rows spread evenly.

    Groups are ordered by positives, size and hash, and dealt out in turn (there
    and back), so folds get alike groups of each kind.
    """
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_total"), F.count_if(F.col(label) == 1).alias("_positive")
    )
    ranked = global_rank(
        sizes.withColumn("_h", draw_hash("fold", group, seed)), ["-_positive", "-_total", "_h", group], name="_r"
    )
    turn = (F.col("_r") - 1) % (2 * folds)
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int")
    return df.join(ranked.select(group, fold.alias("fold")), group)


def row_folds(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """Label-stratified folds of single rows, in hash order within the label."""
    ranked = global_rank(
        df.withColumn("_h", draw_hash("fold", key, seed)), ["_h", key], by=[label], name="_r"
    )
    return ranked.withColumn("fold", ((F.col("_r") - 1) % folds).cast("int")).drop("_h", "_r")
