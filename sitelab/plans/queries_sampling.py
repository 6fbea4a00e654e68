"""Sampling, scheduling, grouping, splitting, set operations and assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelab.functions.scoring import gc_bin
from sitelab.functions.sequences import centre_crop, gc_fraction
from sitelab.operators import components as K
from sitelab.operators import quality as Y
from sitelab.operators import replicates as A
from sitelab.operators import sampling as M
from sitelab.operators import splits as P
from sitelab.operators.ordering import global_rank, top_k
from sitelab.plans import flows
from sitelab.plans.registry import query
from sitelab.plans.views import table
from sitelab.session import new_path
from sitelab.sources.publish import publish_pool
from sitelab.sources.sinks import append_parquet, concatenate, write_parquet

SEED = 20260721


def _h(tag: str, key: str = "id", seed: int = SEED) -> str:
    return f"sha256('{seed}|{tag}|' || CAST({key} AS STRING))"


@query("k1_stable_sample", f"SELECT id FROM v_pool WHERE label = 0 AND split = 'dev' ORDER BY {_h('dev_1to10')} LIMIT 250")
def _(src):
    return M.stable_sample(src.v_pool.filter("label = 0 AND split = 'dev'").select("id"), 250, "dev_1to10", "id")


@query("k1_stable_sample_beyond_heap", f"SELECT id FROM v_pool ORDER BY {_h('large')} LIMIT 10500")
def _(src):
    return M.stable_sample(src.v_pool.select("id"), 10_500, "large", "id")


@query("k3_uniform_pool", f"SELECT id, chrom FROM v_pool WHERE label = 0 ORDER BY {_h('reservoir', seed=42)} LIMIT 500")
def _(src):
    return M.stable_sample(src.v_pool.filter("label = 0").select("id", "chrom"), 500, "reservoir", "id", seed=42)


def _draw_sql(where: str, n: int, tag: str, seed: int) -> str:
    """Slots 0..n-1 from a pool in hash order, repeated in turn when the pool is short."""
    return f"""SELECT id, CAST(i AS BIGINT) AS slot FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY {_h(tag, seed=seed)}, id) - 1 AS r, COUNT(*) OVER () AS size FROM v_pool WHERE label = 0 AND {where}) d,
  range(0, {n}) g(i) WHERE i % size = r"""


_EPOCH, _BASE = 2, 42
_NUMBER = _BASE + 1009 * (_EPOCH + 1)
for _strategy, _where, _n in (
    ("random", "TRUE", 900),
    ("matched", "matched", 2500),
    ("hard", "hard", 600),
    ("easy", "NOT hard AND NOT matched", 400),
    ("guided", "guided", 1500),
):

    @query(f"k4_epoch_draw_{_strategy}", _draw_sql(_where, _n, _strategy, _NUMBER))
    def _(src, strategy=_strategy, n=_n):
        pool = src.v_pool.filter("label = 0").select("id", "matched", "hard", "guided")
        return M.epoch_draw(pool, n, strategy, _EPOCH, _BASE).select("id", "slot")


_MIXED = " UNION ALL ".join(
    f"SELECT id FROM ({_draw_sql(w, n, t, _NUMBER)})"
    for w, n, t in (("NOT hard AND NOT matched", 1000, "easy"), ("matched", 2000, "matched"), ("hard", 2000, "hard"))
)


@query("k4_epoch_draw_mixed", f"SELECT id, COUNT(*) AS times FROM ({_MIXED}) GROUP BY id")
def _(src):
    pool = src.v_pool.filter("label = 0").select("id", "matched", "hard", "guided")
    return M.epoch_draw(pool, 5000, "mixed", _EPOCH, _BASE).groupBy("id").agg(F.count("slot").alias("times"))


_UNIQUE = " UNION ".join(
    f"SELECT id FROM ({_draw_sql(w, n, t, _NUMBER)})"
    for w, n, t in (("NOT hard AND NOT matched", 60, "easy"), ("matched", 120, "matched"), ("hard", 120, "hard"))
)


@query(
    "k4_epoch_draw_mixed_unique",
    f"""WITH u AS ({_UNIQUE}), f AS (SELECT id FROM v_pool WHERE label = 0 AND id NOT IN (SELECT id FROM u) ORDER BY {_h('fill', seed=_NUMBER)}, id LIMIT (SELECT 300 - COUNT(*) FROM u)),
a AS (SELECT id FROM u UNION ALL SELECT id FROM f)
SELECT id, ROW_NUMBER() OVER (ORDER BY {_h('shuffle', seed=_NUMBER)}, id) - 1 AS slot FROM a""",
)
def _(src):
    pool = src.v_pool.filter("label = 0").select("id", "matched", "hard", "guided")
    return M.epoch_draw(pool, 300, "mixed", _EPOCH, _BASE, unique=True).select("id", "slot")


@query(
    "w10_rotating_slice",
    f"""SELECT id, CAST(slot AS BIGINT) AS slot FROM (SELECT id, ((r - (3 * 5000) % n) % n + n) % n AS slot FROM (
  SELECT id, ROW_NUMBER() OVER (ORDER BY {_h('permutation', seed=42 + 88001)}, id) - 1 AS r, COUNT(*) OVER () AS n FROM v_pool WHERE label = 0)) WHERE slot < 5000""",
)
def _(src):
    return M.rotating_slice(src.v_pool.filter("label = 0").select("id"), 5000, 3, "id", 42).select("id", "slot")


_POS_SEED = 42 + 7919 * 2
_SCHEDULE = f"""
p AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS r, COUNT(*) OVER () AS n FROM v_pool WHERE label = 1 AND split = 'train'),
s AS (SELECT i, ROW_NUMBER() OVER (ORDER BY sha256('{_POS_SEED}|positive|' || CAST(i AS STRING)), i) - 1 AS slot FROM range(0, 4000) g(i)),
schedule AS (SELECT p.id, s.slot FROM s JOIN p ON s.i % p.n = p.r)"""


@query("k5_positive_schedule", f"WITH {_SCHEDULE} SELECT id, slot FROM schedule")
def _(src):
    positives = src.v_pool.filter("label = 1 AND split = 'train'").select("id")
    return M.positive_schedule(positives, 4000, 1, "id", 42).select("id", "slot")


@query(
    "j17_ranking_pairs",
    f"WITH {_SCHEDULE}, d AS ({_draw_sql('TRUE', 4000, 'random', 42 + 1009 * 2)}) SELECT s.slot, s.id AS positive_id, d.id AS negative_id FROM schedule s JOIN d ON d.slot = s.slot",
)
def _(src):
    positives = M.positive_schedule(src.v_pool.filter("label = 1 AND split = 'train'").select("id"), 4000, 1, "id", 42)
    pool = src.v_pool.filter("label = 0").select("id", "matched", "hard", "guided")
    return M.ranking_pairs(positives, M.epoch_draw(pool, 4000, "random", 1, 42), "id", "id")


def _ratio_sql(split: str, ratio: int, fit: bool) -> str:
    used = f"LEAST(p, FLOOR(q / {ratio}))" if fit else "p"
    pos = _h(f"{split}_positive") if fit else _h(f"{split}_1to{ratio}")
    neg = _h(f"{split}_negative") if fit else _h(f"{split}_1to{ratio}")
    return f"""
WITH c AS (SELECT COUNT(*) FILTER (WHERE label = 1) AS p, COUNT(*) FILTER (WHERE label = 0) AS q FROM v_pool WHERE split = '{split}' AND (label = 0 OR id % 3 = 0)),
o AS (SELECT id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY CASE WHEN label = 1 THEN {pos} ELSE {neg} END) AS rn FROM v_pool WHERE split = '{split}' AND (label = 0 OR id % 3 = 0))
SELECT id, label FROM o, c WHERE rn <= CASE WHEN label = 1 THEN {used} ELSE {used} * {ratio} END"""


@query("k6_ratio_set_dev", _ratio_sql("dev", 10, False))
def _(src):
    rows = src.v_pool.filter("label = 0 OR id % 3 = 0").select("id", "label", "split")
    return P.ratio_set(rows, "dev", 10, "id", fit_positives=False).select("id", "label")


@query("k6_exact_ratio_set_calibration", _ratio_sql("calibration", 100, True))
def _(src):
    rows = src.v_pool.filter("label = 0 OR id % 3 = 0").select("id", "label", "split")
    return P.ratio_set(rows, "calibration", 100, "id", fit_positives=True).select("id", "label")


@query(
    "k6_hard_set",
    f"""
WITH k AS (SELECT id, label, split, substr(seq, 48, 7) AS kmer FROM v_pool),
c AS (SELECT id FROM k WHERE split = 'dev' AND label = 0 AND kmer IN (SELECT kmer FROM k WHERE split = 'train' AND label = 1))
SELECT id FROM c ORDER BY {_h('dev_hard')} LIMIT (SELECT GREATEST(2 * (SELECT COUNT(*) FROM k WHERE split = 'dev' AND label = 1), LEAST(150, (SELECT COUNT(*) FROM c))))""",
)
def _(src):
    rows = src.v_pool.select("id", "label", "split", centre_crop("seq", 7).alias("kmer"))
    return P.hard_set(rows, "dev", 2, "id", "kmer", floor=150).select("id")


@query(
    "k7_largest_remainder",
    """
WITH s AS (SELECT strand, CAST(LEAST(9, FLOOR(length(replace(replace(seq, 'A', ''), 'T', '')) / 101.0 * 10)) AS BIGINT) AS gc FROM v_pool WHERE label = 1),
c AS (SELECT strand, gc, COUNT(*) AS m FROM s GROUP BY strand, gc),
r AS (SELECT *, 1237 * m / CAST(SUM(m) OVER () AS DOUBLE) AS raw FROM c),
b AS (SELECT *, FLOOR(raw) AS base, ROW_NUMBER() OVER (ORDER BY raw - FLOOR(raw) DESC, strand DESC, gc DESC) AS rn, 1237 - SUM(FLOOR(raw)) OVER () AS spare FROM r)
SELECT strand, gc, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS n FROM b""",
)
def _(src):
    counts = src.v_pool.filter("label = 1").groupBy("strand", gc_bin(gc_fraction("seq")).alias("gc")).agg(F.count(F.lit(1)).alias("m"))
    return M.largest_remainder(counts, ["strand", "gc"], "m", 1237)


_SELECTED = "STRUCT(id BIGINT, chrom VARCHAR, position BIGINT, crop VARCHAR)[]"
_FREE = "len(list_filter(sel, lambda x: x.crop = o.crop OR (x.chrom = o.chrom AND abs(x.position - o.position) <= 201))) = 0"
_GC = "CAST(LEAST(9, FLOOR(length(replace(replace(seq, 'A', ''), 'T', '')) / 101.0 * 10)) AS BIGINT)"


def _walk_sql(target: int, quota: int) -> str:
    """One row at a time: strata in order up to their quotas, then all rows that are left up to the target."""
    taken = "list_append(sel, {'id': o.id, 'chrom': o.chrom, 'position': o.position, 'crop': o.crop})"
    return f"""
WITH RECURSIVE c AS (SELECT strand, {_GC} AS gc, COUNT(*) AS m FROM v_pool WHERE label = 1 GROUP BY ALL),
r AS (SELECT *, {quota} * m / CAST(SUM(m) OVER () AS DOUBLE) AS raw FROM c),
b AS (SELECT *, FLOOR(raw) AS base, ROW_NUMBER() OVER (ORDER BY raw - FLOOR(raw) DESC, strand DESC, gc DESC) AS rn, {quota} - SUM(FLOOR(raw)) OVER () AS spare FROM r),
q AS (SELECT strand, gc, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b),
p AS MATERIALIZED (SELECT id, chrom, CAST(position AS BIGINT) AS position, strand, substr(seq, 47, 9) AS crop, {_GC} AS gc FROM v_pool WHERE label = 0),
o AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY p.strand, p.gc, {_h('thin', seed=42)}, id) AS i, p.*, p.strand || p.gc AS stratum, quota FROM p JOIN q ON q.strand = p.strand AND q.gc = p.gc WHERE quota > 0),
walk(k, i, stratum, n, sel) USING KEY (k) AS (
  SELECT 1, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST([] AS {_SELECTED})
  UNION
  SELECT k, i, stratum, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN more ELSE sel END FROM (
    SELECT w.k, o.i, o.stratum, CASE WHEN w.stratum = o.stratum THEN w.n ELSE 0 END AS n, sel, {taken} AS more,
      CASE WHEN w.stratum = o.stratum THEN w.n ELSE 0 END < quota AND {_FREE} AS ok FROM walk w JOIN o ON o.i = w.i + 1)),
left_ AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY {_h('fill', seed=42)}, id) AS i, p.* FROM p WHERE id NOT IN (SELECT unnest(sel).id FROM walk)),
fill(k, i, sel) USING KEY (k) AS (
  SELECT 1, CAST(0 AS BIGINT), sel FROM walk
  UNION
  SELECT w.k, o.i, CASE WHEN {_FREE} THEN {taken} ELSE sel END FROM fill w JOIN left_ o ON o.i = w.i + 1 WHERE len(sel) < {target})
SELECT p.id, p.chrom, p.position, p.strand, p.gc FROM p JOIN (SELECT unnest(sel).id AS id FROM fill) USING (id)"""


def _thinned(src, target: int, quota: int):
    pool = src.v_pool.filter("label = 0").withColumn("crop", centre_crop("seq", 9)).withColumn("gc", gc_bin(gc_fraction("seq")))
    strata = src.v_pool.filter("label = 1").groupBy("strand", gc_bin(gc_fraction("seq")).alias("gc")).agg(F.count(F.lit(1)).alias("m"))
    quotas = M.largest_remainder(strata, ["strand", "gc"], "m", quota)
    kept = M.thin_to_quotas(pool, "id", "chrom", "position", "crop", 201, ["strand", "gc"], quotas, target, 42)
    return kept.select("id", "chrom", F.col("position").cast("bigint").alias("position"), "strand", "gc")


@query("k8_thinned_negatives", _walk_sql(200, 200))
def _(src):
    """Quotas that all strata can fill."""
    return _thinned(src, 200, 200)


@query("k8_thinned_negatives_refilled", _walk_sql(220, 180))
def _(src):
    """More rows than the quotas give: the rest comes from all strata."""
    return _thinned(src, 220, 180)


_CLOSURE = """
node AS (SELECT DISTINCT site_id, gene_id AS g FROM s),
pts AS (SELECT DISTINCT chrom, strand, position FROM s),
adj AS (SELECT chrom, strand, position, LAG(position) OVER (PARTITION BY chrom, strand ORDER BY position) AS previous FROM pts),
pairs AS (
  SELECT a.gene_id AS x, b.gene_id AS y FROM adj JOIN s a ON a.chrom = adj.chrom AND a.strand = adj.strand AND a.position = adj.position
    JOIN s b ON b.chrom = adj.chrom AND b.strand = adj.strand AND b.position = adj.previous WHERE adj.position - adj.previous <= 100
  UNION SELECT a.gene_id, b.gene_id FROM s a JOIN s b ON a.chrom = b.chrom AND a.position = b.position
  UNION SELECT a.gene_id, b.gene_id FROM s a JOIN s b ON a.seq = b.seq),
sym AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
closure(x, y) AS (SELECT gene_id, gene_id FROM s GROUP BY gene_id UNION SELECT c.x, m.y FROM closure c JOIN sym m ON m.x = c.y),
low AS (SELECT gene_id AS g, MIN(site_id) AS m FROM s GROUP BY gene_id),
comp AS (SELECT x AS g, MIN(m) AS component FROM closure JOIN low ON low.g = closure.y GROUP BY x),
members AS (SELECT s.site_id, component FROM s JOIN comp ON comp.g = s.gene_id)"""
_SITES_SQL = "s AS (SELECT v.site_id, chrom, position, strand, gene_id, seq, label FROM v_sites v JOIN v_seq q ON q.site_id = v.site_id)"


_LIMBS = ", ".join(f"sum(CAST('0x' || substr(h, {i}, 8) AS BIGINT))" for i in range(1, 64, 8))


_REGIONS = ("exon:protein_coding", "three_prime_utr", "intron", "exon:lncRNA")


def _group_sites(src):
    return src.v_site_seq.select(
        F.col("site_id").alias("site_key"), "chrom", "position", "strand", "label", "seq", F.array("gene_id").alias("genes"),
        F.element_at(F.array(*map(F.lit, _REGIONS)), (F.col("site_id") % 4 + 1).cast("int")).alias("region"),
        gc_fraction("seq").alias("gc"), ((F.col("site_id") % 60) / 100.0).alias("efficiency"),
    )


@query(
    "k9_leakage_components",
    f"WITH RECURSIVE {_SITES_SQL}, {_CLOSURE} SELECT site_id AS site_key, component, COUNT(*) OVER (PARTITION BY component) AS group_size FROM members",
)
def _(src):
    return K.leakage_components(_group_sites(src))


def _missing_genes(src):
    """Sites without genes, as NULL or as placeholders, still share sequences, centres and windows."""
    placeholders = F.when(F.col("site_key") % 10 != 0, F.array(F.lit("NA"), F.lit("")))
    genes = F.when(F.col("site_key") % 5 == 0, placeholders).otherwise(F.col("genes"))
    return _group_sites(src).withColumn("genes", genes)


_SOME_GENES = _SITES_SQL.replace("gene_id", "CASE WHEN v.site_id % 5 = 0 THEN 'only ' || CAST(v.site_id AS STRING) ELSE v.gene_id END AS gene_id")


@query(
    "k9_missing_genes",
    f"WITH RECURSIVE {_SOME_GENES}, {_CLOSURE} SELECT site_id AS site_key, component, COUNT(*) OVER (PARTITION BY component) AS group_size FROM members",
)
def _(src):
    return K.leakage_components(_missing_genes(src))


@query(
    "k10_group_ids",
    f"""WITH RECURSIVE {_SITES_SQL}, {_CLOSURE} SELECT component, 'LG_' || substr(sha256(concat_ws('|', count(*), {_LIMBS})), 1, 16) AS group_id
FROM (SELECT component, sha256(CAST(site_id AS STRING)) AS h FROM members) GROUP BY component""",
)
def _(src):
    groups = flows.cut(K.leakage_components(_group_sites(src)))
    return K.group_digests(groups, "site_key", "component")


def _split_ctes(sites: str) -> str:
    """The group split pass by pass as CTE split_site: features, tiers, and per pass the leads, the axes and what they fill."""
    pct = P.PERCENT
    tier = " ".join(f"WHEN MAX(share) >= {least!r} THEN {i}" for i, least in enumerate(P.TIERS))
    tier += " " + " ".join(f"WHEN h < '{below}' THEN {len(P.TIERS) + i}" for i, below in enumerate(P.WAVES))
    profile = """'chrom:' || chrom, 'region:' || CASE site_id % 4 WHEN 0 THEN 'coding_like' WHEN 1 THEN 'UTR' WHEN 2 THEN 'intron_like' ELSE 'other_exonic' END,
  'gc:' || CAST(LEAST(9, FLOOR(length(replace(replace(seq, 'A', ''), 'T', '')) / 101.0 * 10)) AS BIGINT),
  'efficiency:' || CAST(LEAST(5, FLOOR(((site_id % 60) / 100.0) / CAST(0.1 AS DOUBLE))) AS BIGINT)"""
    parts = [
        f"""site AS MATERIALIZED (SELECT s.*, component FROM s JOIN comp ON comp.g = s.gene_id),
each AS (SELECT component, unnest(CASE WHEN label = 1 THEN ['total', 'positive', {profile}] ELSE ['total'] END) AS feature FROM site),
held0 AS MATERIALIZED (SELECT component, feature, COUNT(*) AS c FROM each GROUP BY component, feature),
totals AS MATERIALIZED (SELECT feature, SUM(c) AS t FROM held0 GROUP BY feature),
shared AS MATERIALIZED (SELECT h.*, c / t AS share, {_h('split', 'component')} AS h FROM held0 h JOIN totals USING (feature)),
tiers AS MATERIALIZED (SELECT component, CASE {tier} ELSE {len(P.TIERS) + len(P.WAVES)} END AS tier FROM shared GROUP BY component, h),
filled0 AS (SELECT feature, 'train' AS split, CAST(0 AS BIGINT) AS n FROM totals)"""
    ]
    for i in range(len(P.TIERS) + len(P.WAVES) + 1):
        had = ", ".join(f"COALESCE(SUM(n) FILTER (WHERE split = '{s}'), 0) AS h{k}" for k, s in enumerate(pct))
        off = ", ".join(f"ABS(h{k} * 100 - (h0 + h1 + h2 + h3) * {v})" for k, v in enumerate(pct.values()))
        lacks = ", ".join(f"GREATEST(0, t * {v} - h{k} * 100 - COALESCE(o, 0) * {v}) AS r{k}" for k, v in enumerate(pct.values()))
        edges, upto, fixed = [], "", 0
        for k, v in enumerate(pct.values()):
            upto, fixed = f"{upto} + r{k}" if upto else f"r{k}", fixed + v
            edges.append(f"CASE WHEN r0 + r1 + r2 + r3 > 0 THEN ({upto}) / (r0 + r1 + r2 + r3) ELSE {fixed} / 100 END AS e{k}")
        turn = " ".join(f"WHEN middle < e{k} THEN '{s}'" for k, s in enumerate(pct))
        parts.append(
            f"""had{i} AS MATERIALIZED (SELECT t.feature, t.t, {had} FROM totals t LEFT JOIN filled{i} f ON f.feature = t.feature GROUP BY t.feature, t.t),
off{i} AS MATERIALIZED (SELECT *, GREATEST({off}) / t AS off FROM had{i}),
lead{i} AS MATERIALIZED (SELECT component, MAX(STRUCT_PACK(off := o.off, share := s.share, feature := s.feature)).feature AS lead
  FROM shared s JOIN tiers USING (component) JOIN off{i} o ON o.feature = s.feature WHERE tier = {i} GROUP BY component),
part{i} AS MATERIALIZED (SELECT s.*, lead FROM shared s JOIN lead{i} USING (component)),
room{i} AS (SELECT b.feature, {lacks} FROM off{i} b LEFT JOIN (SELECT feature, SUM(c) AS o FROM part{i} WHERE feature <> lead GROUP BY feature) x ON x.feature = b.feature),
edge{i} AS MATERIALIZED (SELECT feature AS lead, {', '.join(edges)} FROM room{i}),
laid{i} AS (SELECT component, lead, (COALESCE(SUM(c) OVER (PARTITION BY lead ORDER BY h, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 + c)
  / (SUM(c) OVER (PARTITION BY lead) * 2) AS middle FROM part{i} WHERE feature = lead),
dealt{i} AS MATERIALIZED (SELECT component, CASE {turn} ELSE 'test' END AS split FROM laid{i} JOIN edge{i} USING (lead)),
filled{i + 1} AS MATERIALIZED (SELECT feature, split, n FROM filled{i} UNION ALL SELECT feature, split, SUM(c) FROM part{i} JOIN dealt{i} USING (component) GROUP BY feature, split)"""
        )
    every = " UNION ALL ".join(f"SELECT component, split FROM dealt{i}" for i in range(len(P.TIERS) + len(P.WAVES) + 1))
    return f"{sites}, {_CLOSURE}, {', '.join(parts)}, split_site AS MATERIALIZED (SELECT * FROM site JOIN ({every}) USING (component))"


def _crossing_sql(rows: str, keys: list[tuple[str, str]], known: str = "TRUE") -> str:
    """The leakage suite over ``rows``: keys in several splits, and neighbours within 100 of which not all are in one split."""
    counted = " UNION ALL ".join(
        f"SELECT '{n}' AS assertion, COUNT(*) AS v FROM (SELECT {k} FROM {rows} WHERE {known if n.startswith('gene') else 'TRUE'} GROUP BY ALL HAVING COUNT(DISTINCT split) > 1)"
        for n, k in keys
    )
    return f"""SELECT assertion, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(v AS BIGINT) AS violations FROM ({counted} UNION ALL SELECT 'overlapping_windows_not_cross_split', COUNT(*)
  FROM (SELECT *, LAG(position) OVER w AS pp, LAG(a) OVER w AS pa, LAG(b) OVER w AS pb FROM (SELECT chrom, strand, position, MIN(split) AS a, MAX(split) AS b FROM {rows} GROUP BY chrom, strand, position)
    WINDOW w AS (PARTITION BY chrom, strand ORDER BY position)) WHERE position - pp <= 100 AND LEAST(a, pa) <> GREATEST(b, pb))"""


_SPLIT_KEYS = [
    ("gene_id_not_cross_split", "gene_id"),
    ("exact_sequence_not_cross_split", "seq"),
    ("genomic_key_not_cross_split", "site_id"),
    ("genomic_center_not_cross_split", "chrom, position"),
    ("leakage_group_not_cross_split", "component"),
]


@query("k11_group_split", f"WITH RECURSIVE {_split_ctes(_SITES_SQL)} SELECT site_id AS site_key, component, split, label FROM split_site")
def _(src):
    return flows.split_sites(_group_sites(src)).select("site_key", "component", "split", "label")


@query("y1_leakage_suite", f"WITH RECURSIVE {_split_ctes(_SITES_SQL)} {_crossing_sql('split_site', _SPLIT_KEYS)}")
def _(src):
    return Y.leakage_suite(flows.cut(flows.split_sites(_group_sites(src))))


@query(
    "y1_leakage_suite_missing_genes",
    f"WITH RECURSIVE {_split_ctes(_SOME_GENES)} {_crossing_sql('split_site', _SPLIT_KEYS, known=chr(39).join(['gene_id NOT LIKE ', 'only %', '']))}",
)
def _(src):
    """Sites without known genes are split by their other attributes, and their placeholders are no leak."""
    return Y.leakage_suite(flows.cut(flows.split_sites(_missing_genes(src))))


_Y1 = [
    ("gene_id_not_cross_split", "gene_id"),
    ("exact_sequence_not_cross_split", "seq"),
    ("genomic_key_not_cross_split", "CAST(id AS STRING)"),
    ("genomic_center_not_cross_split", "chrom || ':' || CAST(position AS STRING)"),
    ("leakage_group_not_cross_split", "strand"),
]


@query("y1_leakage_suite_on_row_split", _crossing_sql("v_pool", _Y1))
def _(src):
    rows = src.v_pool.withColumn("genes", F.array("gene_id"))
    return Y.leakage_suite(rows, key="id", group="strand")


_RATIO = 4


def _ratio_sql(name: str, p: str, q: str) -> str:
    return f"""SELECT '{name}_exact_1to{_RATIO}' AS assertion, CASE WHEN p = 0 THEN GREATEST(q, 1) ELSE ABS(p * {_RATIO} - q) END AS v FROM (SELECT {p} AS p, {q} AS q FROM
  (SELECT COUNT(*) FILTER (WHERE label = 1) AS np, COUNT(*) FILTER (WHERE label = 0) AS nq FROM v_pool WHERE split = '{name}'))"""


@query(
    "y1_publication_suite",
    f"""WITH good AS (SELECT site_id, COUNT(*) FILTER (WHERE depth >= 20 AND alt = 0) AS g, COUNT(*) AS n FROM v_obs GROUP BY site_id),
more AS (SELECT 'strict_all_samples_covered_and_alt_zero' AS assertion, COUNT(*) FILTER (WHERE COALESCE(g, 0) < 6 OR g < n) AS v FROM v_pool LEFT JOIN good ON site_id = id WHERE label = 0
  UNION ALL SELECT 'sequence_context_length_and_centre', COUNT(*) FILTER (WHERE length(seq) <> 101 OR substr(seq, 51, 1) <> 'C') FROM v_pool
  UNION ALL {_ratio_sql("calibration", f"LEAST(np, nq // {_RATIO})", f"LEAST(np, nq // {_RATIO}) * {_RATIO}")} UNION ALL {_ratio_sql("test", "np", "nq")}
  UNION ALL SELECT 'test_not_used_for_hard_negative_mining', COUNT(*) FROM v_pool WHERE hard AND label = 0 AND split = 'test' AND id % 2 = 0)
{_crossing_sql("v_pool", _Y1)} UNION ALL SELECT assertion, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(v AS BIGINT) FROM more""",
)
def _(src):
    """All eleven assertions over a row split, some of which fail there."""
    pool = src.v_pool.withColumn("genes", F.array("gene_id"))
    sets = {"calibration": P.ratio_set(pool, "calibration", _RATIO, "id", True), "test": pool.filter("split = 'test'")}
    counts = src.v_obs.withColumnRenamed("site_id", "id")
    mined = pool.filter("hard AND label = 0 AND id % 2 = 0")
    return Y.publication_suite(pool, pool.filter("label = 0"), counts, sets, mined, 6, _RATIO, key="id", group="strand")


@query("k13_validation_rows", f"SELECT site_id FROM v_sites ORDER BY {_h('validation', 'site_id', 42)} LIMIT 20")
def _(src):
    return M.stable_sample(src.v_sites.select("site_id"), 20, "validation", "site_id", seed=42)


@query("k13_first_rows", "SELECT site_id, chrom, position FROM v_sites ORDER BY chrom, position, site_id LIMIT 20")
def _(src):
    return top_k(src.v_sites, 20, ["chrom", "position", "site_id"]).select("site_id", "chrom", "position")


@query(
    "k14_train_sample",
    f"""SELECT id, label FROM v_pool WHERE label = 1 AND split = 'train' UNION ALL SELECT * FROM (SELECT id, label FROM v_pool WHERE label = 0 AND split = 'train'
  ORDER BY {_h('train_negative', seed=42 + 1009)} LIMIT (SELECT 3 * COUNT(*) FROM v_pool WHERE label = 1 AND split = 'train'))""",
)
def _(src):
    return M.train_sample(src.v_pool.filter("split = 'train'").select("id", "label"), "label", "id", 3, 42)


@query(
    "u1_union_by_name",
    """SELECT site_id, chrom, CAST(label AS STRING) AS label, 'NA' AS strand, 'a' AS origin FROM v_sites WHERE label = 1
UNION ALL SELECT site_id, chrom, 'NA', strand, 'b' FROM v_sites WHERE label = 0""",
)
def _(src):
    a = src.v_sites.filter("label = 1").select("site_id", "chrom", "label", F.lit("a").alias("origin"))
    b = src.v_sites.filter("label = 0").select("strand", "chrom", "site_id", F.lit("b").alias("origin"))
    both = a.unionByName(b, allowMissingColumns=True)
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in ("label", "strand")]
    return both.select("site_id", "chrom", *filled, "origin")


@query(
    "u2_priority_union",
    """SELECT gene_id, chrom, origin FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gene_id ORDER BY pri, chrom) AS rn FROM (
  SELECT DISTINCT gene_id, chrom, 'broad' AS origin, 0 AS pri FROM v_sites WHERE label = 1 UNION ALL SELECT DISTINCT gene_id, chrom, 'final', 1 FROM v_sites WHERE label = 0)) WHERE rn = 1""",
)
def _(src):
    rows = src.v_sites
    broad = rows.filter("label = 1").select("gene_id", "chrom", F.lit("broad").alias("origin")).distinct()
    final = rows.filter("label = 0").select("gene_id", "chrom", F.lit("final").alias("origin")).distinct()
    return A.priority_union([broad, final], ["gene_id"])


@query("u3_distinct_union", "SELECT gene_id FROM v_sites WHERE label = 1 UNION SELECT gene_id FROM v_sites WHERE site_id % 3 = 0")
def _(src):
    return src.v_sites.filter("label = 1").select("gene_id").union(src.v_sites.filter("site_id % 3 = 0").select("gene_id")).distinct()


@query("u4_difference", "SELECT gene_id FROM v_sites WHERE label = 0 EXCEPT SELECT gene_id FROM v_sites WHERE label = 1")
def _(src):
    return src.v_sites.filter("label = 0").select("gene_id").subtract(src.v_sites.filter("label = 1").select("gene_id"))


@query(
    "u5_shared_groups",
    "SELECT COUNT(*) AS shared FROM (SELECT gene_id FROM v_pool WHERE split = 'train' INTERSECT SELECT gene_id FROM v_pool WHERE split = 'dev')",
)
def _(src):
    train = src.v_pool.filter("split = 'train'").select("gene_id")
    return train.intersect(src.v_pool.filter("split = 'dev'").select("gene_id")).agg(F.count(F.lit(1)).alias("shared"))


@query(
    "u6_set_equality",
    """SELECT (SELECT COUNT(*) FROM (SELECT gene_id FROM v_pool WHERE label = 1 EXCEPT SELECT gene_id FROM v_pool WHERE label = 0)) AS only_expected,
  (SELECT COUNT(*) FROM (SELECT gene_id FROM v_pool WHERE label = 0 EXCEPT SELECT gene_id FROM v_pool WHERE label = 1)) AS only_observed,
  (SELECT COUNT(*) FROM (SELECT gene_id FROM v_pool WHERE label = 0 INTERSECT SELECT gene_id FROM v_pool WHERE label = 1)) AS in_both""",
)
def _(src):
    return Y.same_keys(src.v_pool.filter("label = 1"), src.v_pool.filter("label = 0"), ["gene_id"])


@query(
    "y4_count_parity",
    """
SELECT a.site_id, a.sample, a.ref AS generated_ref, COALESCE(b.ref, 0) AS direct_ref, a.alt AS generated_alt, COALESCE(b.alt, 0) AS direct_alt,
  a.ref = COALESCE(b.ref, 0) AND a.alt = COALESCE(b.alt, 0) AS validation_pass
FROM v_counts a LEFT JOIN (SELECT site_id, sample, ref, CASE WHEN site_id % 500 = 0 THEN alt + 1 ELSE alt END AS alt FROM v_counts WHERE site_id % 701 <> 0) b ON b.site_id = a.site_id AND b.sample = a.sample""",
)
def _(src):
    counts = src.v_counts
    other = counts.filter("site_id % 701 <> 0").withColumn("alt", F.when(F.col("site_id") % 500 == 0, F.col("alt") + 1).otherwise(F.col("alt")))
    return Y.parity(counts, other, ["site_id", "sample"], ["ref", "alt"])


@query(
    "y5_expected_counts",
    """
SELECT x AS assertion, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, v AS violations FROM (
  SELECT 'label_is_binary' AS x, COUNT(*) FILTER (WHERE label NOT IN (0, 1)) AS v FROM v_pool UNION ALL
  SELECT 'context_length_101', COUNT(*) FILTER (WHERE length(seq) <> 101) FROM v_pool UNION ALL
  SELECT 'centre_is_C', COUNT(*) FILTER (WHERE substr(seq, 51, 1) <> 'C') FROM v_pool UNION ALL
  SELECT 'split_is_train', COUNT(*) FILTER (WHERE split <> 'train') FROM v_pool)""",
)
def _(src):
    return Y.violations(
        src.v_pool,
        {
            "label_is_binary": ~F.col("label").isin(0, 1),
            "context_length_101": F.length("seq") != 101,
            "centre_is_C": F.substring("seq", 51, 1) != "C",
            "split_is_train": F.col("split") != "train",
        },
    )


@query(
    "y6_same_selection",
    f"""WITH a AS (SELECT id FROM v_pool ORDER BY {_h('same')} LIMIT 300)
SELECT COUNT(*) AS n, sha256(string_agg(CAST(id AS STRING), ',' ORDER BY CAST(id AS STRING))) AS digest, TRUE AS same_in_both_orders FROM a""",
)
def _(src):
    one = M.stable_sample(src.v_pool.select("id"), 300, "same", "id")
    two = M.stable_sample(src.v_pool.repartition(7).select("id"), 300, "same", "id")
    tagged = one.withColumn("run", F.lit(1)).unionByName(two.withColumn("run", F.lit(2)))
    digests = Y.selection_digest(tagged, ["run"], "id")
    # The sorted text digest is for selections of a checked, small size only.
    text = one.agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","), 256).alias("digest")
    )
    same = digests.agg((F.min("digest") == F.max("digest")).alias("same_in_both_orders"), F.min("n").alias("n"))
    return text.join(same, "n")


@query(
    "y7_expected_metrics",
    """SELECT model_id, CASE WHEN model_id = 'm9' OR ABS(value - want) > 1e-9 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT model_id, AVG(score) AS value, CASE WHEN model_id = 'm1' THEN AVG(score) + 0.001 ELSE AVG(score) END AS want FROM v_pred GROUP BY model_id UNION ALL SELECT 'm9', NULL, 0.5)""",
)
def _(src):
    means = src.v_pred.groupBy("model_id").agg(F.avg("score").alias("value"))
    expected = means.withColumn("value", F.when(F.col("model_id") == "m1", F.col("value") + 0.001).otherwise(F.col("value")))
    extra = src.v_pred.groupBy(F.lit("m9").alias("model_id")).agg(F.max(F.lit(0.5)).alias("value"))
    return Y.expected_values(means, expected.unionByName(extra), ["model_id"], 1e-9)


@query(
    "y9_dictionary_match",
    """
WITH e AS (SELECT chrom, MAX(position) AS length FROM v_sites WHERE label = 1 AND chrom <> 'chr5' GROUP BY chrom),
o AS (SELECT chrom, MAX(position) + CASE WHEN chrom = 'chr2' THEN 1 ELSE 0 END AS length FROM v_sites WHERE label = 1 AND chrom <> 'chr1' GROUP BY chrom)
SELECT COALESCE(e.chrom, o.chrom) AS chrom, CASE WHEN o.chrom IS NULL THEN 'missing_observed' WHEN e.chrom IS NULL THEN 'unexpected' WHEN e.length <> o.length THEN 'length_differs' ELSE 'match' END AS state
FROM e FULL JOIN o ON o.chrom = e.chrom""",
)
def _(src):
    rows = src.v_sites.filter("label = 1")
    expected = rows.filter("chrom <> 'chr5'").groupBy("chrom").agg(F.max("position").alias("length"))
    observed = rows.filter("chrom <> 'chr1'").groupBy("chrom").agg(F.max("position").alias("length"))
    observed = observed.withColumn("length", F.when(F.col("chrom") == "chr2", F.col("length") + 1).otherwise(F.col("length")))
    return Y.dictionary_match(expected, observed, "chrom", "length")


@query(
    "s9_pruned_parquet_scan",
    "SELECT source, lang, COUNT(*) AS rows, MAX(n_chars) AS longest FROM documents GROUP BY source, lang",
)
def _(src):
    docs = table(src.spark, src.sf_dir, "documents").select("source", "lang", "n_chars")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("rows"), F.max("n_chars").alias("longest"))


@query(
    "s12_indexed_pool",
    "SELECT id AS site_id, matched, hard, ROW_NUMBER() OVER (ORDER BY chrom, position, strand, id) AS row_id FROM v_pool WHERE label = 0 AND split = 'train'",
)
def _(src):
    """The pool goes through the gate: unique keys, sound rows, the expected number; what was published is read back."""
    pool = src.v_pool.filter("label = 0 AND split = 'train'")
    path = new_path(src.spark, "pool")
    columns = [F.col("id").alias("site_id"), "chrom", "position", "strand", "matched", "hard", "seq"]
    publish_pool(
        pool.select(*columns), path, ["chrom", "position", "strand", "site_id"], "site_id",
        rules=Y.context_rules() | {"position_not_negative": F.col("position") < 0}, expected=pool.count(), required=["chrom", "position", "seq"],
    )
    published = src.spark.read.parquet(path)
    # Flags of the folder names come back as text.
    return published.select("site_id", F.col("matched").cast("boolean"), F.col("hard").cast("boolean"), "row_id")


@query("s9_concatenated_pools", "SELECT id, split, chrom, CASE WHEN split = 'dev' THEN strand END AS strand FROM v_pool WHERE split <> 'train'")
def _(src):
    """Pools written one by one, one of them with a further column and one in two appends, read back as one table."""
    paths = []
    for split in ("dev", "calibration", "test"):
        rows = src.v_pool.filter(F.col("split") == split)
        paths.append(new_path(src.spark, "pool"))
        rows = rows.select("id", "split", "chrom", *(["strand"] if split == "dev" else []))
        if split == "test":
            write_parquet(rows.filter("id % 2 = 0"), paths[-1])
            append_parquet(rows.filter("id % 2 = 1"), paths[-1])
        else:
            write_parquet(rows, paths[-1])
    whole = new_path(src.spark, "pool")
    concatenate(src.spark, paths, whole)
    return src.spark.read.parquet(whole).select("id", "split", "chrom", "strand")
