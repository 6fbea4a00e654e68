"""Replicate counts to site statistics, and the tables built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.functions.scoring import coverage_bin
from sitelab.operators.skew import first_by, with_key_count

MIN_DEPTH = 20


def array_median(values: Column) -> Column:
    """Exact median of a short sorted array; NULL when empty."""
    n = F.size(values)
    lower = F.get(values, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def array_mad(values: Column, centre: Column) -> Column:
    return array_median(F.array_sort(F.transform(values, lambda v: F.abs(v - centre))))


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def array_range(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def per_sample(sites: DataFrame, samples: Sequence[tuple], counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every site with every sample of the sheet; a missing pair counts as empty.

    ``samples`` is the sample sheet (sample, grp): a handful of rows.
    """
    sheet = F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(g).alias("grp")) for s, g in samples])
    full = sites.withColumn("_s", F.explode(sheet)).select(*sites.columns, "_s.sample", "_s.grp")
    values = [c for c in counts.columns if c not in [*key, "sample", "grp"]]
    joined = full.join(counts.drop("grp"), [*key, "sample"], "left")
    return joined.select(*full.columns, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def site_statistics(
    counts: DataFrame,
    site: Sequence[str],
    group_sizes: dict[str, int],
    min_depth: int = MIN_DEPTH,
    min_replicates: int = 2,
) -> DataFrame:
    """One row per site from long counts (site, sample, grp, depth, ref, alt).

    One shuffle on the site. The arrays hold one number per sample, so their
    length is that of the sample sheet. Rates of replicates below ``min_depth``
    are missing, never zero. A sample of the sheet without a row counts as depth
    0; it is added after the aggregation instead of being joined in as a row.
    """
    samples = sum(group_sizes.values())
    covered = F.col("depth") >= min_depth
    rate = F.when(F.col("depth") > 0, F.col("alt") / F.col("depth")).otherwise(F.lit(0.0))

    def rates(group: str) -> Column:
        return F.array_sort(F.collect_list(F.when(covered & (F.col("grp") == group), rate)))

    def pooled(column: str, group: str) -> Column:
        return F.sum(F.when(covered & (F.col("grp") == group), F.col(column)).otherwise(F.lit(0)))

    wide = counts.groupBy(*site).agg(
        rates("treated").alias("_t"),
        rates("control").alias("_c"),
        F.array_sort(F.collect_list("depth")).alias("_d"),
        F.max(rate).alias("max_rate"),
        F.max("alt").alias("_max_alt"),
        F.coalesce(F.max(F.when(covered, F.col("alt"))), F.lit(0)).alias("_max_covered_alt"),
        pooled("alt", "treated").alias("pooled_treated_alt"),
        pooled("ref", "treated").alias("pooled_treated_ref"),
        pooled("alt", "control").alias("pooled_control_alt"),
        pooled("ref", "control").alias("pooled_control_ref"),
    )
    # Zeros of the absent samples go in front, which keeps the array sorted.
    absent = F.greatest(F.lit(samples) - F.size("_d"), F.lit(0))
    wide = wide.withColumn("_d", F.concat(F.array_repeat(F.lit(0).cast("bigint"), absent), F.col("_d").cast("array<bigint>")))
    base = wide.select(
        "*",
        array_median(F.col("_t")).alias("treated_median"),
        array_median(F.col("_c")).alias("control_median"),
        F.size("_t").alias("treated_covered"),
        F.size("_c").alias("control_covered"),
    )
    enough = (F.col("treated_covered") >= min_replicates) & (F.col("control_covered") >= min_replicates)
    base = base.withColumn("raw_difference", F.when(enough, F.col("treated_median") - F.col("control_median")))
    all_covered = (F.col("treated_covered") == group_sizes["treated"]) & (
        F.col("control_covered") == group_sizes["control"]
    )
    return base.select(
        *site,
        "treated_covered",
        "control_covered",
        all_covered.alias("all_covered"),
        "treated_median",
        "control_median",
        array_mad(F.col("_t"), F.col("treated_median")).alias("treated_mad"),
        array_mad(F.col("_c"), F.col("control_median")).alias("control_mad"),
        array_mean(F.col("_t")).alias("treated_mean"),
        array_mean(F.col("_c")).alias("control_mean"),
        array_range(F.col("_t")).alias("treated_range"),
        array_range(F.col("_c")).alias("control_range"),
        "raw_difference",
        F.when(F.col("raw_difference").isNotNull(), F.greatest("raw_difference", F.lit(0.0))).alias("corrected"),
        "pooled_treated_alt",
        "pooled_treated_ref",
        "pooled_control_alt",
        "pooled_control_ref",
        F.get("_d", F.lit(0)).alias("minimum_depth"),
        array_median(F.col("_d")).alias("median_depth"),
        array_mean(F.col("_d").cast("array<double>")).alias("mean_depth"),
        "max_rate",
        (F.col("_max_alt") == 0).alias("all_alt_zero"),
        (F.col("_max_covered_alt") == 0).alias("covered_alt_zero"),
    )


def depth_prefilter(
    counts: DataFrame, site: Sequence[str], k: int = 2, min_depth: int = MIN_DEPTH
) -> DataFrame:
    """Sites with at least k samples of each group at the depth, on reported depth alone."""
    deep = F.col("depth") >= min_depth
    return (
        counts.groupBy(*site)
        .agg(
            F.count_if(deep & (F.col("grp") == "treated")).alias("treated_deep"),
            F.count_if(deep & (F.col("grp") == "control")).alias("control_deep"),
        )
        .filter((F.col("treated_deep") >= k) & (F.col("control_deep") >= k))
    )


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each stage of a filter chain, in one pass."""
    passed = F.lit(True)
    sums, names = [], []
    for i, (name, predicate) in enumerate(stages, 1):
        passed = passed & F.coalesce(predicate, F.lit(False))
        sums.append(F.count_if(passed).alias(f"s{i}"))
        names.append((i, name))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("stage_order"),
                F.lit(name).alias("filter_stage"),
                F.col(f"s{i}").alias("retained_rows"),
            )
            for i, name in names
        ]
    )
    return df.agg(*sums).select(F.inline(rows))


def drop_repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep rows whose key occurs once; all copies of a repeated key go."""
    return with_key_count(df, key, "_copies").filter(F.col("_copies") == 1).drop("_copies")


def collapse_annotations(
    annotations: DataFrame, key: Sequence[str], strand: str, expected: Column, ids: Sequence[str]
) -> DataFrame:
    """Sorted distinct ids per key, from rows on the expected strand if any, else from all.

    Ids repeat heavily, and sets are merged on the map side, so a popular key
    ships its distinct ids only.
    """
    match = F.col(strand) == expected
    sets = []
    for c in ids:
        real = F.when(~F.col(c).isin("-", "NA", ""), F.col(c))
        sets.append(F.collect_set(F.when(match, real)).alias(f"_m_{c}"))
        sets.append(F.collect_set(real).alias(f"_a_{c}"))
    grouped = annotations.groupBy(*key).agg(F.max(match.cast("int")).alias("_any"), *sets)

    def joined(c: str) -> Column:
        chosen = F.when(F.col("_any") == 1, F.col(f"_m_{c}")).otherwise(F.col(f"_a_{c}"))
        text = F.concat_ws(",", F.array_sort(chosen))
        return F.when(text == "", "NA").otherwise(text).alias(c)

    return grouped.select(*key, *[joined(c) for c in ids])


def gene_coverage(sites: DataFrame, genes: str = "genes") -> DataFrame:
    """Per gene: site counts by label, mean of the site medians, and its log2 bin."""
    exploded = sites.select(F.explode(genes).alias("gene_id"), "label", "median_depth")
    mean = F.avg("median_depth")
    return exploded.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("site_count"),
        F.count_if(F.col("label") == 1).alias("positive_site_count"),
        F.count_if(F.col("label") == 0).alias("negative_site_count"),
        mean.alias("mean_site_median_depth"),
        coverage_bin(mean).alias("coverage_bin"),
    )


def site_gene_coverage(sites: DataFrame, coverage: DataFrame, key: str, genes: str = "genes") -> DataFrame:
    """Median of the gene coverages of a row's genes; a row without gene keeps NULL."""
    pairs = sites.select(key, F.explode(genes).alias("gene_id"))
    # A gene may carry a large share of the sites, hence the salted join.
    table = coverage.select("gene_id", "site_count", "mean_site_median_depth")
    found = pairs.join(table, "gene_id")
    value = found.groupBy(key).agg(F.median("mean_site_median_depth").alias("gene_level_coverage"))
    joined = sites.join(value, key, "left")
    has_gene = F.col("gene_level_coverage").isNotNull()
    return joined.select(
        "*",
        coverage_bin(F.col("gene_level_coverage")).alias("_bin"),
        F.when(has_gene, "MODEL_UNIVERSE_GENE_COVERAGE_PROXY")
        .otherwise("NA_NO_GENE_ID")
        .alias("gene_level_coverage_status"),
    ).withColumn("gene_level_coverage_bin", F.when(has_gene, F.col("_bin"))).drop("_bin")


def group_profile(df: DataFrame, group: str, features: dict[str, Column]) -> DataFrame:
    """Long table (group, feature, value, rows) in one pass over the rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), value.cast("string").alias("value"))
            for name, value in features.items()
        ]
    )
    return (
        df.select(group, F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy(group, "feature", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def class_bias(df: DataFrame, population: str, excluded: Column, triggers: dict[str, Column]) -> DataFrame:
    """Exclusion rate and trigger counts per population."""
    n = F.count(F.lit(1))
    out = F.count_if(excluded)
    return df.groupBy(population).agg(
        n.alias("eligible"),
        out.alias("excluded"),
        (n - out).alias("retained"),
        (out / n).alias("exclusion_rate"),
        *[F.count_if(excluded & t).alias(name) for name, t in triggers.items()],
    )


def bias_guard(audit: DataFrame, population: str, positive: str, negative: str) -> DataFrame:
    """Review needed when positives lose over 10% or over twice the share of negatives."""
    rate = lambda name: F.coalesce(
        F.max(F.when(F.col(population) == name, F.col("exclusion_rate"))), F.lit(0.0)
    )
    return audit.agg(rate(positive).alias("positive_rate"), rate(negative).alias("negative_rate")).withColumn(
        "review_required",
        (F.col("positive_rate") > 0.10) | (F.col("positive_rate") > 2 * F.col("negative_rate")),
    )


def priority_union(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union by key; the row of the earliest table wins."""
    tagged = None
    for i, table in enumerate(tables):
        part = table.withColumn("_priority", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return first_by(tagged, key, [F.col("_priority")]).drop("_priority")
