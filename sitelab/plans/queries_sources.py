"""Readers and writers on text that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelab.operators.ordering import global_rank
from sitelab.plans.queries_replicates import RATES, SAMPLES, statistics
from sitelab.plans.registry import query
from sitelab.session import new_path
from sitelab.sources import sinks as O
from sitelab.sources import text as T


def pileup_lines(src) -> DataFrame:
    """Six-sample pileup text whose counts are those of v_counts."""
    c = F.col
    half = lambda n: F.expr(f"int({n} div 2)")
    bases = F.concat(
        F.lit("^F"), F.repeat(F.lit("."), half("ref")), F.repeat(F.lit(","), (c("ref") - half("ref")).cast("int")), F.lit("$+2ac"),
        F.repeat(F.lit("T"), half("alt")), F.repeat(F.lit("t"), (c("alt") - half("alt")).cast("int")), F.lit("-1g*<>Nn"),
        F.repeat(F.lit("A"), c("other").cast("int")),
    )
    cell = F.concat_ws("\t", c("depth").cast("string"), bases, F.lit("I"))
    wide = src.v_counts.groupBy("site_id").pivot("sample", [s for s, _ in SAMPLES]).agg(F.max(cell))
    cells = [F.coalesce(c(str(s)), F.lit("0\t*\t*")) for s, _ in SAMPLES]
    return wide.select(F.concat_ws("\t", F.lit("chr1"), c("site_id").cast("string"), F.lit("c"), *cells).alias("value"))


@query(
    "s3_pileup_scan",
    "SELECT site_id AS position, sample, depth, ref AS ref_count, alt AS alt_count, other AS other_count, alt // 2 AS forward_alt, alt - alt // 2 AS reverse_alt FROM v_counts",
)
def _(src):
    counts = T.allele_counts(T.parse_pileup(pileup_lines(src), SAMPLES), F.lit("T"))
    names = ("depth", "ref_count", "alt_count", "other_count", "forward_alt", "reverse_alt")
    return counts.filter("reported_depth > 0").select("position", "sample", *[F.col(n).cast("bigint").alias(n) for n in names])


@query(
    "s3_prefiltered_pileup_scan",
    """WITH k AS (SELECT site_id FROM v_counts GROUP BY site_id HAVING COUNT(*) FILTER (WHERE depth >= 20 AND grp = 'treated') >= 2 AND COUNT(*) FILTER (WHERE depth >= 20 AND grp = 'control') >= 2)
SELECT c.site_id AS position, sample, depth, alt AS alt_count FROM v_counts c JOIN k ON k.site_id = c.site_id""",
)
def _(src):
    counts = T.allele_counts(T.parse_pileup(pileup_lines(src), SAMPLES, min_depth=20), F.lit("T"))
    return counts.filter("reported_depth > 0").select("position", "sample", F.col("depth").cast("bigint").alias("depth"), F.col("alt_count").cast("bigint").alias("alt_count"))


@query(
    "f8_pileup_bases",
    """SELECT site_id AS position, sample, ref // 2 AS "C_forward", ref - ref // 2 AS "C_reverse", alt // 2 AS "T_forward", alt - alt // 2 AS "T_reverse", other AS "A_forward" FROM v_counts""",
)
def _(src):
    counts = T.parse_pileup(pileup_lines(src), SAMPLES).filter("reported_depth > 0")
    return counts.select("position", "sample", "C_forward", "C_reverse", "T_forward", "T_reverse", "A_forward")


@query(
    "s4_gtf_scan",
    """SELECT chrom, start0, end0, strand, gene_id, 'NA' AS gene_name, 'T' || CAST(exon_id AS STRING) AS transcript_id,
  CASE WHEN exon_id % 2 = 0 THEN region ELSE 'exon' END AS region_type FROM v_exons WHERE exon_id % 10 <> 0 AND chrom <> 'chr4'""",
)
def _(src):
    c = F.col
    kind = F.when(c("exon_id") % 10 == 0, "gene").otherwise("exon")
    extra = F.when(c("exon_id") % 2 == 0, F.concat(F.lit(' gene_type "'), "region", F.lit('";'))).otherwise(F.lit(""))
    attributes = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "T'), c("exon_id").cast("string"), F.lit('";'), extra)
    text = F.concat_ws(
        "\t", "chrom", F.lit("src"), kind, (c("start0") + 1).cast("string"), c("end0").cast("string"), F.lit("."), "strand", F.lit("."), attributes
    )
    exons = src.v_exons
    comments = exons.select(F.concat(F.lit("#"), text).alias("value")).filter("value LIKE '%chr2%'")
    return T.parse_gtf(exons.select(text.alias("value")).unionByName(comments), "exon", ["chr1", "chr2", "chr3", "chr5"])


@query("s5_vcf_positions", "SELECT chrom, position FROM v_variants WHERE chrom IN ('chr1', 'chr2')")
def _(src):
    record = F.concat_ws("\t", "chrom", F.col("position").cast("string"), F.lit("."), F.lit("C"), F.lit("T"))
    first = src.v_variants.select(record.alias("value"))
    header = src.v_variants.select(F.concat(F.lit("##"), record).alias("value"))
    return T.parse_vcf_positions(first.unionByName(first).unionByName(header), ["chr1", "chr2"])


@query(
    "s6_annotation_scan",
    """SELECT chrom, position, 'C' AS ref, 'T' AS alt, gene_id AS "Gene", CASE WHEN strand = '+' THEN '1' ELSE '-1' END AS "STRAND" FROM v_sites WHERE site_id % 3 <> 0""",
)
def _(src):
    c = F.col
    name = F.concat(F.when(c("site_id") % 3 == 0, "OTHER_").otherwise("REDI_"), "chrom", F.lit("_"), c("position").cast("string"), F.lit("_C_T"))
    text = F.concat_ws("\t", name, "gene_id", F.when(c("strand") == "+", "1").otherwise("-1"))
    lines = src.v_sites.select(text.alias("value"))
    header = src.v_sites.limit(1).select(F.lit("#Uploaded_variation\tGene\tSTRAND").alias("value"))
    lines = lines.unionByName(header)
    return T.parse_annotations(lines, T.annotation_columns(lines))


TILE, PIECE = 1010, 101


def tiles_of(src) -> DataFrame:
    """Contigs made of the site sequences in id order: tiles of ten, each with the next sequence as overlap."""
    ranked = global_rank(src.v_sites.select("chrom", "site_id", "raw_seq"), ["site_id"], by=["chrom"], name="r")
    tile = F.floor((F.col("r") - 1) / 10)
    opens = ((F.col("r") - 1) % 10 == 0) & (F.col("r") > 1)
    shown = ranked.select("chrom", "r", "raw_seq", F.explode(F.when(opens, F.array(tile, tile - 1)).otherwise(F.array(tile))).alias("tile_id"))
    # At most eleven sequences per tile.
    parts = F.array_sort(F.collect_list(F.struct("r", "raw_seq")))
    return shown.groupBy("chrom", "tile_id").agg(F.array_join(F.transform(parts, lambda p: p["raw_seq"]), "").alias("seq"))


def contigs_of(src) -> DataFrame:
    return src.v_sites.groupBy(F.col("chrom").alias("name")).agg((F.count(F.lit(1)) * PIECE).alias("length"))


_CONTIG = """
contig AS (SELECT chrom, string_agg(raw_seq, '' ORDER BY site_id) AS seq, COUNT(*) * 101 AS length FROM v_sites GROUP BY chrom),
spot AS (SELECT s.site_id, s.chrom, (s.site_id * 7919) % (c.length + 40) + 1 AS position, c.length, c.seq FROM v_sites s JOIN contig c ON c.chrom = s.chrom)"""


def spots(src) -> DataFrame:
    sized = src.v_sites.join(contigs_of(src).withColumnRenamed("name", "chrom"), "chrom")
    return sized.select("site_id", "chrom", ((F.col("site_id") * 7919) % (F.col("length") + 40) + 1).alias("position"))


@query(
    "s7_reference_windows",
    f"WITH {_CONTIG} SELECT site_id, CASE WHEN position > 50 AND position + 50 <= length THEN substr(seq, CAST(position - 50 AS BIGINT), 101) END AS window_seq FROM spot",
)
def _(src):
    return T.fetch_windows(spots(src), tiles_of(src), 50, TILE, "window_seq").select("site_id", "window_seq")


@query(
    "a20_candidate_audit",
    f"""WITH {_CONTIG}, cand AS (SELECT chrom, position, length, CASE WHEN site_id % 10 = 0 THEN 'N' ELSE COALESCE(NULLIF(substr(seq, CAST(position AS BIGINT), 1), ''), 'N') END AS ref, substr(seq, CAST(position AS BIGINT), 1) AS o, substr(seq, CAST(position + 1 AS BIGINT), 1) AS z FROM spot),
d AS (SELECT COUNT(*) - COUNT(DISTINCT (chrom, position, ref)) AS duplicate_alleles FROM cand)
SELECT COUNT(*) AS row_count, CAST(0 AS BIGINT) AS missing_contig_rows, COUNT(*) FILTER (WHERE position > length) AS bad_positions, COUNT(*) FILTER (WHERE position <= length AND o = ref) AS one_based_ref_matches,
  COUNT(*) FILTER (WHERE position < length AND z = ref) AS zero_based_ref_matches, ANY_VALUE(duplicate_alleles) AS duplicate_alleles, 'inconsistent_or_unknown' AS coordinate_system FROM cand, d""",
)
def _(src):
    tiles = tiles_of(src)
    found = T.fetch_windows(spots(src), tiles, 0, TILE, "base")
    ref = F.when(F.col("site_id") % 10 == 0, "N").otherwise(F.coalesce("base", F.lit("N")))
    candidates = found.select("chrom", "position", ref.alias("ref"), F.lit("T").alias("alt"))
    return T.audit_candidates(candidates, tiles, contigs_of(src), TILE)


_READS = """
raw AS (SELECT s.site_id, s.chrom, k, s.position - 50 - (k * 13) % 40 AS start, s.raw_seq AS bases,
    CASE (s.site_id + k) % 6 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 99 WHEN 3 THEN 147 WHEN 4 THEN 1024 + 16 ELSE 83 END AS flag, CASE (s.site_id + 2 * k) % 7 WHEN 0 THEN 20 ELSE 30 + k END AS mapq,
    (s.site_id * 3 + k) % 4 AS shape, CASE (s.site_id + 3 * k) % 5 WHEN 0 THEN 15 WHEN 1 THEN 25 ELSE 37 END AS q, CAST(s.site_id AS STRING) || '_' || CAST(k // 2 AS STRING) AS qname
  FROM v_sites s, (VALUES (0), (1), (2), (3), (4), (5)) r(k))"""


def sam_lines(src) -> DataFrame:
    """Six reads around each site with gaps, clips, mates and low qualities."""
    c = F.col
    k = c("k")
    # Spread the sites first: the text below is many times their size.
    rows = src.v_sites.repartition("site_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    sk = lambda a, b, m: (c("site_id") * a + k * b) % m
    flags = F.array(*[F.lit(x) for x in (0, 16, 99, 147, 1024 + 16, 83)])
    cigars = F.array(*[F.lit(x) for x in ("101M", "50M2D51M", "10S91M", "40M5N61M")])
    quality = F.when(sk(1, 3, 5) == 0, 15).when(sk(1, 3, 5) == 1, 25).otherwise(37)
    text = F.concat_ws(
        "\t",
        F.concat(c("site_id").cast("string"), F.lit("_"), F.expr("k div 2").cast("string")),
        F.get(flags, sk(1, 1, 6).cast("int")).cast("string"),
        "chrom",
        (c("position") - 50 - (k * 13) % 40).cast("string"),
        F.when(sk(1, 2, 7) == 0, 20).otherwise(30 + k).cast("string"),
        F.get(cigars, sk(3, 1, 4).cast("int")),
        F.lit("="),
        F.lit("0"),
        F.lit("0"),
        "raw_seq",
        F.repeat(F.chr(quality + 33), 101),
    )
    header = src.v_sites.limit(1).select(F.lit("@HD\tVN:1.6").alias("value"))
    return rows.select(text.alias("value")).unionByName(header)


@query(
    "s8_aligned_reads",
    f"""WITH {_READS} SELECT qname, flag, start, mapq, CASE shape WHEN 0 THEN '101M' WHEN 1 THEN '50M2D51M' WHEN 2 THEN '10S91M' ELSE '40M5N61M' END AS cigar FROM raw WHERE mapq >= 30 AND flag < 1024""",
)
def _(src):
    return T.parse_sam(sam_lines(src)).filter(T.read_filter()).select("qname", "flag", "start", "mapq", "cigar")


@query(
    "p1_read_filter",
    f"WITH {_READS} SELECT flag, mapq, COUNT(*) AS reads FROM raw WHERE mapq >= 30 AND (flag & 3844) = 0 GROUP BY flag, mapq",
)
def _(src):
    return T.parse_sam(sam_lines(src)).filter(T.read_filter()).groupBy("flag", "mapq").agg(F.count(F.lit(1)).alias("reads"))


@query(
    "a1_base_counts_from_reads",
    f"""WITH {_READS}, kept AS (SELECT * FROM raw WHERE mapq >= 30 AND flag < 1024 AND q >= 20),
hit AS (SELECT t.chrom, t.position, r.qname, r.flag, r.q, r.bases, r.shape, t.position - r.start AS d FROM (SELECT DISTINCT chrom, position FROM v_sites) t JOIN kept r ON r.chrom = t.chrom AND t.position BETWEEN r.start AND r.start + 110),
ix AS (SELECT *, CASE shape WHEN 0 THEN CASE WHEN d < 101 THEN d END WHEN 1 THEN CASE WHEN d < 50 THEN d WHEN d >= 52 AND d < 103 THEN d - 2 END
  WHEN 2 THEN CASE WHEN d < 91 THEN d + 10 END ELSE CASE WHEN d < 40 THEN d WHEN d >= 45 AND d < 106 THEN d - 5 END END AS i FROM hit),
once AS (SELECT *, substr(bases, CAST(i + 1 AS BIGINT), 1) AS base, ROW_NUMBER() OVER (PARTITION BY chrom, position, qname ORDER BY q DESC, flag) AS rn FROM ix WHERE i IS NOT NULL)
SELECT chrom, position, """
    + ", ".join(
        f"COUNT(*) FILTER (WHERE base = '{b}' AND (flag & 16) {'<>' if d == 'reverse' else '='} 0) AS \"{b}_{d}\"" for b in "ACGT" for d in ("forward", "reverse")
    )
    + " FROM once WHERE rn = 1 GROUP BY chrom, position",
)
def _(src):
    return T.count_bases(src.v_sites, T.parse_sam(sam_lines(src)), extra=())


@query(
    "s1_s2_tsv_round_trip",
    f"""WITH {RATES} SELECT site_id, CASE WHEN all_covered THEN '1' ELSE '0' END AS all_covered, ROUND(treated_median, 6) AS treated_median, ROUND(raw_difference, 6) AS raw_difference FROM stats""",
)
def _(src):
    path = new_path(src.spark, "tsv")
    O.write_tsv(statistics(src).select("site_id", "all_covered", "treated_median", "raw_difference"), path)
    back = T.read_tsv(src.spark, path)
    number = lambda n: F.round(F.col(n).cast("double"), 6).alias(n)
    return back.select(F.col("site_id").cast("bigint").alias("site_id"), "all_covered", number("treated_median"), number("raw_difference"))


@query("s2_printed_numbers", "SELECT id, model_id, printf('%.12g', score * CASE id % 5 WHEN 0 THEN 1e-7 WHEN 1 THEN 1e15 WHEN 2 THEN 1 WHEN 3 THEN 1000 ELSE 0 END) AS text FROM v_pred")
def _(src):
    scale = F.element_at(F.array(*[F.lit(x) for x in (1e-7, 1e15, 1.0, 1000.0, 0.0)]), (F.col("id") % 5 + 1).cast("int"))
    rows = src.v_pred.select("id", "model_id", (F.col("score") * scale).alias("x"))
    return O.printable(rows).select(F.col("id").cast("bigint").alias("id"), "model_id", F.col("x").alias("text"))


@query("s10_write_once_tables", "SELECT site_id, chrom, position FROM v_sites WHERE label = 1 UNION ALL SELECT site_id, chrom, position FROM v_sites WHERE label = 1")
def _(src):
    rows = src.v_sites.filter("label = 1").select("site_id", "chrom", "position")
    one, two = new_path(src.spark, "parquet"), new_path(src.spark, "json")
    O.write_parquet(rows, one)
    O.write_json(rows, two)
    return src.spark.read.parquet(one).unionByName(src.spark.read.schema("site_id bigint, chrom string, position bigint").json(two))


@query("s11_bed_round_trip", "SELECT chrom, start0, end0 FROM v_exons")
def _(src):
    path = new_path(src.spark, "bed")
    O.write_bed(src.v_exons, path)
    return src.spark.read.option("sep", "\t").schema("chrom string, start0 bigint, end0 bigint").csv(path)


@query("s12_pool_by_flags", "SELECT matched, hard, COUNT(*) AS rows, CAST(COUNT(*) AS BIGINT) AS ids FROM v_pool WHERE label = 0 GROUP BY matched, hard")
def _(src):
    path = new_path(src.spark, "pool")
    pool = src.v_pool.filter("label = 0").select(F.col("id").alias("site_id"), "chrom", "position", "matched", "hard")
    O.write_pool(pool, path, ["chrom", "position", "site_id"])
    back = src.spark.read.parquet(path)
    flags = [F.col(c).cast("boolean").alias(c) for c in ("matched", "hard")]
    return back.groupBy(*flags).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


@query("y8_file_manifest")
def _(src):
    files = O.file_digests(src.spark, src.sf_dir, "*.parquet")
    changed = F.when(F.col("path").endswith("nation.parquet"), F.lit("0")).otherwise(F.col("sha256"))
    manifest = files.filter("path NOT LIKE '%region.parquet'").select("path", changed.alias("sha256"))
    states = O.verify_manifest(files, manifest)
    return states.select(F.element_at(F.split("path", "/"), -1).alias("file"), "state")
