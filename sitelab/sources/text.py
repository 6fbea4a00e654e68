"""Readers for tab-separated tables, pileups, annotations, variants and reads.

Every reader has a ``parse_*`` form over lines (a ``value`` column), so it works
on any text source, and a ``read_*`` form over a path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelab.functions.pileup import COUNT_FIELDS, base_counts
from sitelab.functions.stretches import WIDTH, count_bins, cut_reads

# Read filter of the counting rules.
FILTER_FLAGS = 3844
MIN_MAPQ = 30
MIN_BASEQ = 20
MISSING_TEXT = ("", "NA", "-")


def lines(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Text lines; give ``partitions`` for gzip files, which are read by one task each."""
    df = spark.read.text(path if isinstance(path, str) else list(path))
    return df.repartition(partitions) if partitions else df


def read_tsv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None
) -> DataFrame:
    """Header TSV, plain or gzip, as strings unless a schema is given; missing-value texts become NULL."""
    reader = spark.read.option("sep", "\t").option("header", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("nullValue", "NA")
    df = reader.csv(path)
    if partitions:
        df = df.repartition(partitions)
    clean = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            c = F.rtrim(F.col(f"`{f.name}`"), F.lit("\r"))
            clean.append(F.when(~c.isin(*MISSING_TEXT), c).alias(f.name.rstrip("\r")))
        else:
            clean.append(F.col(f"`{f.name}`"))
    return df.select(*clean)


def fields(df: DataFrame, skip: Sequence[str] = (), keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines as arrays ``f``. Skipped and unfit lines have no array at all, so that no later step parses
    one of their fields. The arrays come out of a generator, below which no filter on a field is
    pushed: each line is made and split once, not again for every condition."""
    parts = F.split(F.rtrim(F.col("value"), F.lit("\r\n")), "\t", -1)
    fit = F.lit(True)
    for prefix in skip:
        fit = fit & ~F.col("value").startswith(prefix)
    if keep is not None:
        fit = fit & keep(parts)
    return df.select(F.explode(F.array(F.when(fit, parts))).alias("f")).filter(F.col("f").isNotNull())


def parse_pileup(
    text: DataFrame,
    samples: Sequence[tuple],
    min_depth: int | None = None,
    k: int = 2,
    bases: Sequence[str] = ("C", "G"),
) -> DataFrame:
    """Multi-sample pileup lines to long base counts (chrom, position, ref, sample, grp, counts...).

    With ``min_depth`` only C/G lines are kept whose reported depth reaches it in
    k samples of each group; that cheap test runs before any base is parsed.
    A line with too few columns is an error.
    """
    width = 3 + 3 * len(samples)
    f = F.col("f")
    bad = F.raise_error(F.concat(F.lit("malformed pileup row: "), F.substring(F.array_join(f, "\t"), 1, 240)))
    rows = fields(text).withColumn("f", F.when(F.size(f) >= width, f).otherwise(bad.cast("array<string>")))
    if min_depth is not None:
        deep = {g: F.lit(0) for _, g in samples}
        for i, (_, g) in enumerate(samples):
            deep[g] = deep[g] + (f[3 + 3 * i].cast("int") >= min_depth).cast("int")
        keep = F.upper(f[2]).isin(*bases)
        for total in deep.values():
            keep = keep & (total >= k)
        rows = rows.filter(keep)
    triples = F.array(
        *[
            F.struct(
                F.lit(s).alias("sample"),
                F.lit(g).alias("grp"),
                f[3 + 3 * i].cast("bigint").alias("reported_depth"),
                f[4 + 3 * i].alias("bases"),
            )
            for i, (s, g) in enumerate(samples)
        ]
    )
    long = rows.select(
        f[0].alias("chrom"), f[1].cast("bigint").alias("position"), F.upper(f[2]).alias("ref"), F.inline(triples)
    )
    counted = long.withColumn("_n", base_counts("bases", "ref"))
    return counted.select("chrom", "position", "ref", "sample", "grp", "reported_depth", *[F.col(f"_n.{n}") for n in COUNT_FIELDS])


def allele_counts(counts: DataFrame, alt: Column) -> DataFrame:
    """depth, ref, alt, other (and alt by direction) of base counts for an alternate base."""

    def count(base: Column, *directions: str) -> Column:
        total = F.lit(0)
        for d in directions:
            for b in "ACGT":
                total = total + F.when(base == b, F.col(f"{b}_{d}")).otherwise(F.lit(0))
        return total

    both = ("forward", "reverse")
    depth = F.lit(0)
    for name in COUNT_FIELDS:
        depth = depth + F.col(name)
    out = counts.withColumns(
        {
            "alt_base": alt,
            "depth": depth,
            "ref_count": count(F.col("ref"), *both),
            "alt_count": count(alt, *both),
            "forward_alt": count(alt, "forward"),
            "reverse_alt": count(alt, "reverse"),
        }
    )
    return out.withColumn("other_count", F.col("depth") - F.col("ref_count") - F.col("alt_count"))


def gtf_attribute(text: Column, key: str) -> Column:
    found = F.regexp_extract(text, rf'(?:^|[\s;]){key} "([^"]*)";', 1)
    return F.when(found != "", found)


def parse_gtf(text: DataFrame, feature: str = "exon", contigs: Sequence[str] | None = None) -> DataFrame:
    """Intervals of one feature, half-open and 0-based; other lines are skipped."""
    f = F.col("f")
    rows = fields(text, ["#"], lambda x: (F.size(x) == 9) & (F.get(x, F.lit(2)) == feature) & F.get(x, F.lit(6)).isin("+", "-"))
    if contigs is not None:
        rows = rows.filter(f[0].isin(*contigs))
    attributes = f[8]
    na = F.lit("NA")
    return rows.select(
        f[0].alias("chrom"),
        (f[3].cast("bigint") - 1).alias("start0"),
        f[4].cast("bigint").alias("end0"),
        f[6].alias("strand"),
        F.coalesce(gtf_attribute(attributes, "gene_id"), na).alias("gene_id"),
        F.coalesce(gtf_attribute(attributes, "gene_name"), na).alias("gene_name"),
        F.coalesce(gtf_attribute(attributes, "transcript_id"), na).alias("transcript_id"),
        F.coalesce(
            gtf_attribute(attributes, "transcript_type"), gtf_attribute(attributes, "gene_type"), F.lit("exon")
        ).alias("region_type"),
    )


def parse_vcf_positions(text: DataFrame, contigs: Sequence[str] | None = None) -> DataFrame:
    """Distinct (chrom, position) of all records of one or several files."""
    rows = fields(text, ["#"], lambda x: F.size(x) >= 2)
    out = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("position"))
    if contigs is not None:
        out = out.filter(F.col("chrom").isin(*contigs))
    return out.distinct()


def parse_annotations(text: DataFrame, columns: Sequence[str], prefix: str = "REDI") -> DataFrame:
    """Annotation rows whose first field is ``PREFIX_chrom_position_ref_alt``; others are skipped."""
    rows = fields(text, ["#"])
    pattern = rf"^{prefix}_(.+)_(\d+)_([ACGT])_([ACGT])$"
    name = F.col("f")[0]
    hit = rows.filter(F.regexp_like(name, F.lit(pattern)))
    part = lambda i: F.regexp_extract(name, pattern, i)
    return hit.select(
        part(1).alias("chrom"),
        part(2).cast("bigint").alias("position"),
        part(3).alias("ref"),
        part(4).alias("alt"),
        *[F.get(F.col("f"), F.lit(i)).alias(c) for i, c in enumerate(columns) if i > 0],
    )


def annotation_columns(text: DataFrame, mark: str = "#Uploaded_variation") -> list[str]:
    """Column names from the header line; one line reaches the driver."""
    header = text.filter(F.col("value").startswith(mark)).first()
    if header is None:
        raise ValueError("annotation header not found")
    return header["value"].rstrip("\r\n")[1:].split("\t")


def parse_sam(text: DataFrame) -> DataFrame:
    """Aligned reads: name, flag, chrom, 1-based start, mapping quality, CIGAR, bases, qualities."""
    f = F.col("f")
    return fields(text, ["@"]).select(
        f[0].alias("qname"),
        f[1].cast("int").alias("flag"),
        f[2].alias("chrom"),
        f[3].cast("bigint").alias("start"),
        f[4].cast("int").alias("mapq"),
        f[5].alias("cigar"),
        f[9].alias("bases"),
        f[10].alias("quals"),
    )


def read_filter(min_mapq: int = MIN_MAPQ, flags: int = FILTER_FLAGS) -> Column:
    return (F.col("flag").bitwiseAND(F.lit(flags)) == 0) & (F.col("mapq") >= min_mapq)


def count_bases(
    sites: DataFrame, reads: DataFrame, min_mapq: int = MIN_MAPQ, min_baseq: int = MIN_BASEQ, extra: Sequence[str] = ("sample",)
) -> DataFrame:
    """Base counts by direction at the sites (chrom, position), by sample.

    Reads are cut at bins of the axis and meet the sites there; a bin's sites are the bits of one
    text, so that the join has a row per read and bin however many sites it covers. Mates that
    overlap at a site count once, by the base of higher quality. Behind the join nothing is
    shuffled: the window keeps a bin in one piece, the reads of a name next to each other, and the
    bases are counted in numpy.
    """
    by = [*extra, "chrom"]
    kept, given = [*by, "qname", "flag"], ["start", "cigar", "bases", "quals"]
    usable = reads.filter(read_filter(min_mapq)).select(*kept, *given).dropna(subset=["chrom", *given])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in usable.schema.fields]
    parts = usable.mapInArrow(
        lambda batches: cut_reads(batches, kept, min_baseq),
        ", ".join([*kinds[: len(kept)], "place bigint, at int, bases binary, quals binary"]),
    )
    behind = F.pmod(F.col("position") - 1, F.lit(WIDTH))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (63 - behind % 64).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.floor(behind / 64) == i, bit)), F.lit(0)) for i in range(WIDTH // 64)]
    bits = F.unhex(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))
    wanted = sites.groupBy("chrom", F.floor((F.col("position") - 1) / WIDTH).alias("place")).agg(bits.alias("wanted"))
    # The number first: it tells most rows apart.
    together = Window.partitionBy("place", *by).orderBy("qname")
    ordered = parts.join(wanted.hint("shuffle_hash"), ["chrom", "place"]).withColumns(
        {"row": F.row_number().over(together), "name": F.dense_rank().over(together)}
    )
    return ordered.drop("qname").mapInArrow(
        lambda batches: count_bins(batches, by, min_baseq),
        ", ".join([*kinds[: len(by)], "position bigint", *[f"{n} bigint" for n in COUNT_FIELDS]]),
    )


def reference_tiles(
    spark: SparkSession, fasta: str, index: DataFrame, tile: int = 4096, overlap: int = 100
) -> DataFrame:
    """Tiles (chrom, tile_id, seq) of an indexed FASTA, each with ``overlap`` following bases.

    ``index`` is the usual five-column index (name, length, offset, line_bases,
    line_width). Tasks seek to their byte ranges, so no task reads a contig whole.
    """
    tiles = index.withColumn("tile_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / tile))))
    begin = F.col("tile_id") * tile
    end = F.least(begin + tile + overlap, F.col("length"))

    def byte(base: Column) -> Column:
        return F.col("offset") + F.floor(base / F.col("line_bases")) * F.col("line_width") + base % F.col("line_bases")

    ranges = tiles.select(
        F.col("name").alias("chrom"),
        F.col("tile_id").cast("bigint").alias("tile_id"),
        byte(begin).cast("bigint").alias("_from"),
        byte(end).cast("bigint").alias("_to"),
    ).repartitionByRange("chrom", "tile_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(fasta) if "://" in fasta else (fs.LocalFileSystem(), fasta)
        with system.open_input_file(name) as handle:
            for batch in batches:
                seqs = [
                    handle.read_at(b - a, a).decode("ascii").replace("\n", "").replace("\r", "").upper()
                    for a, b in zip(batch["_from"], batch["_to"])
                ]
                yield batch[["chrom", "tile_id"]].assign(seq=seqs)

    return ranges.mapInPandas(read, "chrom string, tile_id bigint, seq string")


def parse_fasta_index(text: DataFrame) -> DataFrame:
    f = F.col("f")
    names = ("length", "offset", "line_bases", "line_width")
    return fields(text).select(f[0].alias("name"), *[f[i + 1].cast("bigint").alias(n) for i, n in enumerate(names)])


def fetch_windows(
    sites: DataFrame, tiles: DataFrame, flank: int = 50, tile: int = 4096, keep: str = "window"
) -> DataFrame:
    """The window of 2*flank+1 bases around each 1-based position; NULL when out of bounds.

    Tiles overlap by at least 2*flank bases, so each window lies in one tile and
    one equi-join fetches it.
    """
    first = F.col("position") - 1 - flank
    located = sites.withColumn("_first", first).withColumn(
        "tile_id", F.when(F.col("_first") >= 0, F.floor(F.col("_first") / tile))
    )
    joined = located.join(tiles, ["chrom", "tile_id"], "left")
    width = 2 * flank + 1
    text = F.substring("seq", (F.col("_first") - F.col("tile_id") * tile + 1).cast("int"), F.lit(width))
    return joined.select(*sites.columns, F.when(F.length(text) == width, text).alias(keep))


def audit_candidates(sites: DataFrame, tiles: DataFrame, contigs: DataFrame, tile: int = 4096) -> DataFrame:
    """Coordinate audit of (chrom, position, ref, alt): agreement with the reference read 1-based and 0-based."""
    bounded = sites.join(contigs.select(F.col("name").alias("chrom"), "length"), "chrom", "left")
    inside = F.col("position").between(1, F.col("length"))
    here = fetch_windows(
        fetch_windows(bounded, tiles, 0, tile, "_one").withColumn("position", F.col("position") + 1), tiles, 0, tile, "_zero"
    ).withColumn("position", F.col("position") - 1)
    copies = sites.groupBy("chrom", "position", "ref", "alt").agg((F.count(F.lit(1)) - 1).alias("d"))
    main = here.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("length").isNull()).alias("missing_contig_rows"),
        F.count_if(F.col("length").isNotNull() & ~inside).alias("bad_positions"),
        F.count_if(inside & (F.col("_one") == F.col("ref"))).alias("one_based_ref_matches"),
        F.count_if(inside & (F.col("_zero") == F.col("ref"))).alias("zero_based_ref_matches"),
    )
    repeated = copies.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("duplicate_alleles"))
    # Two one-row tables side by side.
    one = main.withColumn("_k", F.lit(1)).join(repeated.withColumn("_k", F.lit(1)), "_k").drop("_k")
    good = (F.col("row_count") > 0) & (F.col("row_count") == F.col("one_based_ref_matches"))
    return one.withColumn("coordinate_system", F.when(good, "1_based").otherwise("inconsistent_or_unknown"))
