"""Scalar functions and projections over the site and sequence views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelab.functions import scoring as S
from sitelab.functions import sequences as Q
from sitelab.plans.registry import query

# Oracle fragments.
_GC = "(length(replace(replace(seq, 'A', ''), 'T', '')) / 101.0)"


def _entropy(seq: str) -> str:
    n = f"length({seq})"
    terms = []
    for b in "ACGT":
        k = f"(({n} - length(replace({seq}, '{b}', ''))) / CAST({n} AS DOUBLE))"
        terms.append(f"CASE WHEN {k} > 0 THEN -{k} * log2({k}) ELSE 0.0 END")
    return "(" + " + ".join(terms) + ")"


_RUN = "list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x)))"
# All 2-mer runs of the three interesting phases: enumerate the 16 motifs.
_TANDEM = """
WITH motifs AS (SELECT a || b AS motif FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(a), (VALUES ('A'), ('C'), ('G'), ('T')) y(b)),
units AS (
  SELECT site_id, phase, i, substr(seq, 1 + phase + 2 * i, 2) AS motif, length(seq) AS n
  FROM {source}, (VALUES (0), (1)) p(phase), range(0, 51) r(i)
  WHERE 2 + phase + 2 * i <= length(seq)),
marks AS (
  SELECT *, i - row_number() OVER (PARTITION BY site_id, phase, motif ORDER BY i) AS island FROM units),
runs AS (
  SELECT site_id, phase, motif, 2 * count(*) AS bases, max(n) AS n FROM marks GROUP BY site_id, phase, motif, island),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY bases DESC, phase, motif) AS rn FROM runs)
"""


@query(
    "f1_reverse_complement",
    "SELECT site_id, translate(reverse(seq), 'ACGT', 'TGCA') AS revcomp FROM v_seq",
)
def _(src):
    return src.v_seq.select("site_id", Q.reverse_complement("seq").alias("revcomp"))


@query(
    "f2_gc_and_base_counts",
    f"SELECT site_id, ROUND({_GC}, 6) AS gc, CAST(length(seq) - length(replace(seq, 'C', '')) AS BIGINT) AS c_count FROM v_seq",
)
def _(src):
    return src.v_seq.select(
        "site_id",
        F.round(Q.gc_fraction("seq"), 6).alias("gc"),
        Q.base_count("seq", "C").cast("bigint").alias("c_count"),
    )


@query("f3_base_entropy", f"SELECT site_id, ROUND({_entropy('seq')}, 6) AS entropy FROM v_low")
def _(src):
    return src.v_low.select("site_id", F.round(Q.base_entropy("seq"), 6).alias("entropy"))


@query("f4_longest_run", f"SELECT site_id, CAST({_RUN} AS BIGINT) AS run FROM v_low")
def _(src):
    return src.v_low.select("site_id", Q.longest_run("seq").cast("bigint").alias("run"))


@query(
    "f5_tandem_dinucleotide",
    _TANDEM.format(source="v_low")
    + "SELECT site_id, ROUND(bases / CAST(n AS DOUBLE), 6) AS coverage, CAST(phase AS BIGINT) AS phase, motif FROM ranked WHERE rn = 1",
)
def _(src):
    t = Q.tandem_dinucleotide("seq")
    return src.v_low.select("site_id", t.alias("t")).select(
        "site_id",
        F.round("t.coverage", 6).alias("coverage"),
        F.col("t.phase").cast("bigint").alias("phase"),
        F.col("t.motif").alias("motif"),
    )


@query(
    "f6_low_complexity",
    _TANDEM.format(source="v_low")
    + f""", flags AS (
  SELECT q.site_id, {_entropy('q.seq')} < 1.20 AS e, {_RUN.replace('seq', 'q.seq')} >= 20 AS h, r.bases / 101.0 >= 0.80 AS d
  FROM v_low q JOIN ranked r ON q.site_id = r.site_id AND r.rn = 1)
SELECT site_id, e AS entropy_trigger, h AS homopolymer_trigger, d AS dinucleotide_trigger,
  CASE WHEN e OR h OR d THEN concat_ws(';', CASE WHEN e THEN 'entropy_lt_1.20' END,
    CASE WHEN h THEN 'homopolymer_run_ge_20' END, CASE WHEN d THEN 'dinucleotide_tandem_coverage_ge_0.80' END)
    ELSE 'none' END AS triggered_rules,
  CASE WHEN e OR h OR d THEN 'FAIL_LOW_COMPLEXITY' ELSE 'PASS' END AS low_complexity_qc
FROM flags""",
)
def _(src):
    measured = src.v_low.select(
        "site_id",
        Q.base_entropy("seq").alias("e"),
        Q.longest_run("seq").alias("h"),
        Q.tandem_dinucleotide("seq")["coverage"].alias("d"),
    )
    flags = Q.low_complexity(F.col("e"), F.col("h"), F.col("d"))
    return measured.select("site_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "f7_centre_crop",
    "SELECT site_id, substr(seq, 49, 5) AS centre_5mer, substr(seq, 48, 7) AS centre_7mer, substr(seq, 31, 41) AS centre_41 FROM v_seq",
)
def _(src):
    return src.v_seq.select(
        "site_id",
        Q.centre_crop("seq", 5).alias("centre_5mer"),
        Q.centre_crop("seq", 7).alias("centre_7mer"),
        Q.centre_crop("seq", 41).alias("centre_41"),
    )


@query(
    "f9_site_and_sequence_ids",
    """
SELECT id, site_key, seq_hash, sha256(split || '|' || site_key || '|' || seq_hash) AS sequence_id FROM (
  SELECT id, split, chrom || ':' || CAST(position AS STRING) || ':' || strand || ':C:T' AS site_key, sha256(seq) AS seq_hash FROM v_pool)""",
)
def _(src):
    keyed = src.v_pool.select(
        "id", "split", Q.site_key("chrom", "position", "strand").alias("site_key"), Q.sequence_hash("seq").alias("seq_hash")
    )
    return keyed.select("id", "site_key", "seq_hash", Q.sequence_id("split", "site_key", "seq_hash").alias("sequence_id"))


@query(
    "f10_bins",
    f"""
SELECT o.site_id, o.sample,
  CAST(LEAST(12, FLOOR(LOG2(GREATEST(1.0, depth)))) AS BIGINT) AS depth_bin,
  CAST(LEAST(15, FLOOR(LOG2(GREATEST(1.0, depth * 40.0)))) AS BIGINT) AS coverage_bin,
  CAST(LEAST(9, FLOOR({_GC} * 10)) AS BIGINT) AS gc_bin,
  CAST(LEAST(5, FLOOR(CAST(alt AS DOUBLE) / depth / 0.1)) AS BIGINT) AS efficiency_bin
FROM v_obs o JOIN v_seq q ON o.site_id = q.site_id""",
)
def _(src):
    joined = src.v_obs.join(src.v_seq, "site_id")
    return joined.select(
        "site_id",
        "sample",
        S.depth_bin("depth").alias("depth_bin"),
        S.coverage_bin(F.col("depth") * 40.0).alias("coverage_bin"),
        S.gc_bin(Q.gc_fraction("seq")).alias("gc_bin"),
        S.efficiency_bin(F.col("alt") / F.col("depth")).alias("efficiency_bin"),
    )


@query(
    "f11_class_maps",
    """
SELECT exon_id, region, CASE WHEN lower(region) LIKE '%coding%' OR lower(region) LIKE '%missense%' OR lower(region) LIKE '%synonymous%'
    THEN 'coding_like' WHEN lower(region) LIKE '%utr%' THEN 'UTR' WHEN lower(region) LIKE '%intron%' THEN 'intron_like'
    ELSE 'other_exonic' END AS region_class,
  CASE WHEN CAST(substr(chrom, 4) AS INT) BETWEEN 1 AND 22 THEN 'autosome' ELSE 'sex_or_mito' END AS chrom_class
FROM (SELECT exon_id, concat('chr', CAST(exon_id % 30 + 1 AS STRING)) AS chrom, CASE exon_id % 4 WHEN 0 THEN concat('Coding_', region)
  WHEN 1 THEN concat(region, '_5_prime_UTR') WHEN 2 THEN concat('intron_', region) ELSE region END AS region FROM v_exons)""",
)
def _(src):
    exons = src.v_exons
    k = F.col("exon_id") % 4
    region = (
        F.when(k == 0, F.concat(F.lit("Coding_"), "region"))
        .when(k == 1, F.concat("region", F.lit("_5_prime_UTR")))
        .when(k == 2, F.concat(F.lit("intron_"), "region"))
        .otherwise(F.col("region"))
    )
    chrom = F.concat(F.lit("chr"), (F.col("exon_id") % 30 + 1).cast("string"))
    named = exons.select("exon_id", region.alias("region"), chrom.alias("chrom"))
    return named.select(
        "exon_id", "region", S.region_class("region").alias("region_class"), S.chrom_class("chrom").alias("chrom_class")
    )


@query(
    "f12_id_lists",
    """
SELECT site_id, array_to_string(list_sort(list_distinct(list_filter(string_split(ids, ','), lambda x: x NOT IN ('', 'NA', '-')))), ',') AS ids
FROM (SELECT site_id, concat_ws(',', gene_id, 'NA', concat('G', CAST(site_id % 13 AS STRING)), '-', gene_id, '') AS ids FROM v_sites)""",
)
def _(src):
    text = F.concat_ws(
        ",", "gene_id", F.lit("NA"), F.concat(F.lit("G"), (F.col("site_id") % 13).cast("string")), F.lit("-"), "gene_id", F.lit("")
    )
    return src.v_sites.select("site_id", F.concat_ws(",", S.id_list(text)).alias("ids"))


@query(
    "f13_hash_uniform",
    """
SELECT site_id, ROUND(CAST('0x' || substr(sha256('42|' || CAST(site_id AS STRING)), 1, 15) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE), 6) AS u,
  ROUND(CAST('0x' || substr(sha256(raw_seq), 1, 15) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE), 6) AS stored
FROM v_sites""",
)
def _(src):
    return src.v_sites.select(
        "site_id",
        F.round(S.hash_uniform("site_id", 42), 6).alias("u"),
        F.round(S.hash_fraction(F.sha2("raw_seq", 256)), 6).alias("stored"),
    )


@query(
    "f14_coverage_status",
    """
SELECT site_id, sample, CASE WHEN depth = 0 THEN 'inadequate_zero_depth' WHEN depth < 20 THEN 'inadequate_low_depth'
  WHEN alt = 0 THEN 'adequate_zero_alt' ELSE 'adequate_with_alt' END AS coverage_status FROM v_obs""",
)
def _(src):
    return src.v_obs.select("site_id", "sample", S.coverage_status("depth", "alt").alias("coverage_status"))


@query(
    "f16_logit_and_sigmoid",
    """
WITH s AS (SELECT model_id, AVG(score) AS m, STDDEV_POP(score) AS d FROM v_pred GROUP BY model_id)
SELECT p.id, p.model_id, ROUND(LN(q / (1 - q)), 6) AS logit,
  ROUND(1 / (1 + EXP(-GREATEST(-50, LEAST(50, score * 120 - 60)))), 6) AS sigmoid,
  ROUND(1 / (1 + EXP(-(score - m) / d)), 6) AS z_sigmoid
FROM (SELECT *, LEAST(GREATEST(score, 1e-7), 1 - 1e-7) AS q FROM v_pred) p JOIN s ON p.model_id = s.model_id""",
)
def _(src):
    pred = src.v_pred
    stats = pred.groupBy("model_id").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d"))
    return pred.join(stats, "model_id").select(
        "id",
        "model_id",
        F.round(S.logit("score"), 6).alias("logit"),
        F.round(S.sigmoid(F.col("score") * 120 - 60), 6).alias("sigmoid"),
        F.round(S.z_sigmoid("score", F.col("m"), F.col("d")), 6).alias("z_sigmoid"),
    )


@query(
    "f18_one_hot_and_tokens",
    """
SELECT site_id, list_sum(hot) AS ones, list_position(list_slice(hot, 102, 202), 1.0) AS first_c, array_to_string(tokens, ' ') AS tokens FROM (
  SELECT site_id, list_concat(list_concat(list_transform(string_split(seq, ''), lambda c: CASE WHEN c = 'A' THEN 1.0 ELSE 0.0 END),
      list_transform(string_split(seq, ''), lambda c: CASE WHEN c = 'C' THEN 1.0 ELSE 0.0 END)),
    list_concat(list_transform(string_split(seq, ''), lambda c: CASE WHEN c = 'G' THEN 1.0 ELSE 0.0 END),
      list_transform(string_split(seq, ''), lambda c: CASE WHEN c = 'T' THEN 1.0 ELSE 0.0 END))) AS hot,
    list_concat([0], list_concat(list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN 5 WHEN 'T' THEN 6 WHEN 'C' THEN 7 WHEN 'G' THEN 8 ELSE 9 END), [2])) AS tokens
  FROM v_seq)""".replace("list_sum(hot) AS ones", "CAST(list_sum(hot) AS DOUBLE) AS ones").replace(
        "list_position(list_slice(hot, 102, 202), 1.0)", "CAST(list_position(list_slice(hot, 102, 202), 1.0) AS BIGINT)"
    ),
)
def _(src):
    vocabulary = {"A": 5, "T": 6, "C": 7, "G": 8}
    coded = src.v_seq.select(
        "site_id", Q.one_hot("seq").alias("hot"), Q.token_ids("seq", vocabulary, 0, 2, 9).alias("tokens")
    )
    return coded.select(
        "site_id",
        F.aggregate("hot", F.lit(0.0), lambda a, v: a + v).alias("ones"),
        F.array_position(F.slice("hot", 102, 101), 1.0).alias("first_c"),
        F.concat_ws(" ", F.col("tokens").cast("array<string>")).alias("tokens"),
    )


@query(
    "p5_context_filter",
    """
SELECT site_id, raw_seq FROM v_sites WHERE length(raw_seq) = 101 AND substr(raw_seq, 51, 1) = 'C'
  AND translate(raw_seq, 'ACGT', '') = ''""",
)
def _(src):
    return src.v_sites.filter(Q.context_ok("raw_seq")).select("site_id", "raw_seq")


@query(
    "p5_oriented_context",
    """
SELECT site_id, CASE WHEN strand = '+' THEN raw_seq ELSE translate(reverse(raw_seq), 'ACGT', 'TGCA') END AS seq FROM v_sites
WHERE substr(raw_seq, 51, 1) = CASE WHEN strand = '+' THEN 'C' ELSE 'G' END""",
)
def _(src):
    sites = src.v_sites.filter(F.substring("raw_seq", 51, 1) == Q.expected_centre("strand"))
    seq = F.when(F.col("strand") == "+", F.col("raw_seq")).otherwise(Q.reverse_complement("raw_seq"))
    return sites.select("site_id", seq.alias("seq"))


@query(
    "p6_feature_filter",
    "SELECT exon_id, chrom, strand, region FROM v_exons WHERE chrom IN ('chr1', 'chr3', 'chr5') AND strand = '+' AND region IN (SELECT MIN(region) FROM v_exons UNION SELECT MAX(region) FROM v_exons)",
)
def _(src):
    keep = F.col("chrom").isin("chr1", "chr3", "chr5") & (F.col("strand") == "+")
    ends = src.v_exons.agg(F.array(F.min("region"), F.max("region")).alias("ends")).select(F.explode("ends").alias("region"))
    return src.v_exons.filter(keep).join(ends.distinct(), "region", "left_semi").select("exon_id", "chrom", "strand", "region")


@query(
    "p7_allele_rule",
    """
SELECT site_id, CASE WHEN (strand = '+' AND ref = 'C' AND alt = 'T') OR (strand = '-' AND ref = 'G' AND alt = 'A') THEN 'pass' ELSE 'fail' END AS rule
FROM (SELECT site_id, strand, substr(raw_seq, 51, 1) AS ref, CASE substr(raw_seq, 51, 1) WHEN 'C' THEN 'T' WHEN 'G' THEN 'A' ELSE 'N' END AS alt FROM v_sites)""",
)
def _(src):
    ref = F.substring("raw_seq", 51, 1)
    alt = F.when(ref == "C", "T").when(ref == "G", "A").otherwise("N")
    return src.v_sites.select("site_id", Q.allele_rule(F.col("strand"), ref, alt).alias("rule"))


@query(
    "p8_normalised_records",
    f"""
WITH m AS (SELECT site_id, MEDIAN(depth) AS md FROM v_obs GROUP BY site_id),
raw AS (SELECT p.id, p.label, p.seq, CASE WHEN p.id % 3 = 0 THEN '' WHEN p.id % 3 = 1 THEN 'nan' ELSE '25.5' END AS median_depth,
    CASE WHEN p.id % 5 = 0 THEN '' ELSE '7.25' END AS gene_cov, CASE WHEN p.id % 4 = 0 THEN 'motif_similar_strict' END AS difficulty,
    CASE WHEN p.id % 6 = 0 THEN 0.5 END AS gc_given, md
  FROM v_pool p LEFT JOIN m ON m.site_id = p.id)
SELECT id, COALESCE(difficulty, CASE WHEN label = 1 THEN 'positive' ELSE 'random_strict' END) AS negative_type,
  ROUND(COALESCE(CASE WHEN median_depth IN ('', 'nan') THEN NULL ELSE CAST(median_depth AS DOUBLE) END, md, 0.0), 6) AS median_depth,
  ROUND(COALESCE(CASE WHEN gene_cov = '' THEN NULL ELSE CAST(gene_cov AS DOUBLE) END,
    CASE WHEN median_depth IN ('', 'nan') THEN NULL ELSE CAST(median_depth AS DOUBLE) END, md, 0.0), 6) AS gene_coverage,
  ROUND(CAST(COALESCE(gc_given, {_GC}) AS DOUBLE), 6) AS gc_fraction, ROUND({_entropy('seq')}, 6) AS entropy, sha256(seq) AS sequence_hash
FROM raw""",
)
def _(src):
    from sitelab.functions.records import normalise

    depths = src.v_obs.groupBy(F.col("site_id").alias("id")).agg(F.median("depth").alias("sample_median_depth"))
    k = F.col("id")
    raw = src.v_pool.select(
        "id",
        "label",
        F.col("seq").alias("sequence_context"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "nan").otherwise("25.5").alias("median_depth"),
        F.when(k % 5 == 0, "").otherwise("7.25").alias("gene_level_coverage"),
        F.when(k % 4 == 0, "motif_similar_strict").alias("negative_difficulty"),
        F.when(k % 6 == 0, F.lit(0.5)).alias("gc_fraction"),
    ).join(depths, "id", "left")
    rounded = [F.round(c, 6).alias(c) for c in ("median_depth", "gene_coverage", "gc_fraction", "entropy")]
    return normalise(raw).select("id", "negative_type", *rounded, "sequence_hash")
