"""Leakage groups: connected components over shared attributes and near windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelab.functions.records import known_genes
from sitelab.operators.ordering import Ordered, Scan
from sitelab.operators.skew import key_counts
from sitelab.session import cut


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for the nodes of the edges; component is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). A step
    needs only the smallest neighbour of each node, which partial aggregation
    delivers, and an equi-join back that the adaptive skew join splits where a hub
    has a large share of the edges. Every round is checkpointed once.
    """
    current = cut(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    while not _is_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(lowest, "u")
            .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = cut(small)
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent: the fixed point of the steps."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(0).alias("top"), F.lit(1).alias("n")),
        F.struct(F.col("v").alias("node"), F.lit(1).alias("top"), F.lit(0).alias("n")),
    )
    per_node = edges.select(F.inline(ends)).groupBy("node").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    return per_node.filter((F.col("n") > 1) | ((F.col("top") == 1) & (F.col("n") > 0))).isEmpty()


def window_runs(sites: DataFrame, key: str, chrom: str, position: str, strand: str, distance: int) -> DataFrame:
    """(key, chrom, strand, run): run is the first position of an unbroken row of near sites of a strand.

    Neighbours linked one by one would be a chain as long as the axis wherever sites lie
    close, and a chain takes the most rounds. A NULL strand is a strand; without a
    chromosome or position there is no run.
    """
    placed = sites.filter(F.col(chrom).isNotNull() & F.col(position).isNotNull()).select(
        F.col(key).alias("a"), F.col(chrom).alias("chrom"), F.coalesce(F.concat(F.lit("="), strand), F.lit("")).alias("strand"),
        F.col(position).alias("at"),
    )
    opens = F.col("_before").isNull() | (F.col("at") - F.col("_before") > distance)
    return (
        Ordered(placed, ["at", "a"], ["chrom", "strand"])
        .scan(_before=Scan("max", "at", exclusive=True))
        .with_column("_start", F.when(opens, F.col("at")))
        .scan(run=Scan("max", "_start"))
        .frame()
        .select("a", "chrom", "strand", "run")
    )


def leakage_edges(
    sites: DataFrame,
    key: str = "site_key",
    genes: str = "genes",
    sequence: str = "seq",
    chrom: str = "chrom",
    position: str = "position",
    strand: str = "strand",
    distance: int = 100,
) -> DataFrame:
    """Edges (a, b) between sites that share a gene, a sequence, a centre or a window.

    An attribute links each of its sites to the smallest one, never all pairs; the run of
    windows that a site lies in is an attribute too.
    """
    centre = F.concat_ws(":", F.lit("c"), F.col(chrom), F.col(position).cast("string"))
    # Without a known gene the other attributes still link.
    names = F.concat(
        F.transform(known_genes(genes), lambda g: F.concat(F.lit("g:"), g)),
        F.array(F.concat(F.lit("s:"), F.sha2(F.col(sequence), 256)), centre),
    )
    runs = window_runs(sites, key, chrom, position, strand, distance)
    run = F.concat_ws(":", F.lit("w"), "chrom", "strand", F.col("run").cast("string"))
    # Written once: the smallest member and the join below both read it.
    member = sites.select(F.col(key).alias("a"), F.explode(names).alias("attribute")).unionByName(runs.select("a", run.alias("attribute")))
    member = cut(member.filter(F.col("attribute").isNotNull()))
    smallest = (
        member.groupBy("attribute")
        .agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return member.join(smallest, "attribute").select("a", "b").filter(F.col("a") != F.col("b"))


def leakage_components(sites: DataFrame, key: str = "site_key", **columns) -> DataFrame:
    """(key, component, group_size); a site without any link is its own component."""
    found = connected_components(leakage_edges(sites, key, **columns), "a", "b")
    labelled = sites.select(key).join(found.withColumnRenamed("node", key), key, "left")
    labelled = labelled.select(key, F.coalesce("component", F.col(key)).alias("component"))
    sizes = key_counts(labelled, ["component"], "group_size")
    return labelled.join(sizes, "component").select(key, "component", "group_size")


#: Hexadecimal digits of a summed part of a member's digest: sums of 32-bit numbers stay exact.
LIMB = 8


def group_digests(members: DataFrame, key: str, group: str) -> DataFrame:
    """(group, group_id): ``LG_`` and 16 hex digits that follow from the set of member keys.

    Each key's digest is cut into numbers that are summed over the group; the id is the
    digest of the sums and the number of members. Sums merge in any order, so a group
    of any size is aggregated where its rows are, by one rule.
    """
    hashed = members.select(group, F.sha2(F.col(key).cast("string"), 256).alias("_h"))
    limbs = [F.conv(F.substring("_h", 1 + i * LIMB, LIMB), 16, 10).cast("bigint") for i in range(64 // LIMB)]
    # Upper and lower half apart: sums stay in whole numbers of 64 bits up to 2^47 members.
    halves = [h for i, v in enumerate(limbs) for h in (F.sum(F.shiftright(v, 16)).alias(f"_u{i}"), F.sum(v.bitwiseAND(F.lit(65535))).alias(f"_l{i}"))]
    sums = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *halves)
    whole = [(F.col(f"_u{i}").cast("decimal(20,0)") * 65536 + F.col(f"_l{i}")).cast("string") for i in range(64 // LIMB)]
    text = F.concat_ws("|", F.col("_n").cast("string"), *whole)
    return sums.select(group, F.concat(F.lit("LG_"), F.substring(F.sha2(text, 256), 1, 16)).alias("group_id"))
