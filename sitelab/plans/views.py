"""Input views over the driver tables, as portable SQL for Spark and the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "lineitem orders part customer supplier nation region events documents labels embeddings"
).split()

VIEWS: dict[str, str] = {
    # Six samples; a seventh line of an order adds to the first sample.
    "v_obs": """
SELECT l_orderkey AS site_id, (l_linenumber - 1) % 6 + 1 AS sample,
  CASE WHEN (l_linenumber - 1) % 6 + 1 <= 3 THEN 'treated' ELSE 'control' END AS grp,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS depth,
  CAST(FLOOR(SUM(CAST(l_quantity AS BIGINT) * CAST(ROUND(l_discount * 100) AS BIGINT))
    * CASE WHEN (l_linenumber - 1) % 6 + 1 <= 3 THEN 5 ELSE 1 END / 100.0) AS BIGINT) AS alt
FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) % 6 + 1""",
    "v_counts": """
SELECT site_id, sample, grp, depth, alt,
  CASE WHEN depth - alt < depth % 3 THEN depth - alt ELSE depth % 3 END AS other,
  depth - alt - CASE WHEN depth - alt < depth % 3 THEN depth - alt ELSE depth % 3 END AS ref
FROM v_obs""",
    "v_sites": """
SELECT o_orderkey AS site_id, concat('chr', CAST(o_custkey % 5 + 1 AS STRING)) AS chrom,
  (o_orderkey * o_orderkey * 13 + o_custkey * 7919) % 10000019 + 60 AS position,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  concat('G', CAST(o_custkey AS STRING)) AS gene_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label,
  translate(substr(concat(md5(concat(CAST(o_orderkey AS STRING), 'a')), md5(concat(CAST(o_orderkey AS STRING), 'b')),
    md5(concat(CAST(o_orderkey AS STRING), 'c')), md5(concat(CAST(o_orderkey AS STRING), 'd'))), 1, 101),
    '0123456789abcdef', 'ACGTACGTACGTACGT') AS raw_seq
FROM orders""",
    # Sites with their sequence, from one scan.
    "v_site_seq": """
SELECT site_id, chrom, position, strand, gene_id, label,
  concat(substr(raw_seq, 1, 50), 'C', substr(raw_seq, 52, 50)) AS seq FROM v_sites""",
    "v_seq": """
SELECT site_id, seq FROM v_site_seq""",
    "v_low": """
SELECT site_id, CASE site_id % 5
    WHEN 0 THEN concat(substr(seq, 1, 20), repeat('AC', 40), 'A')
    WHEN 1 THEN concat(substr(seq, 1, 50), repeat('C', 25), substr(seq, 76, 26))
    WHEN 2 THEN concat('G', repeat('TC', 45), substr(seq, 92, 10))
    ELSE seq END AS seq
FROM v_seq""",
    "v_exons": """
SELECT p_partkey AS exon_id, concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS chrom,
  (p_partkey * 48271 * 7) % 10000019 AS start0, (p_partkey * 48271 * 7) % 10000019 + p_size * 400 AS end0,
  CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand, p_brand AS gene_id, p_type AS region FROM part""",
    "v_variants": """
SELECT DISTINCT concat('chr', CAST(o_custkey % 5 + 1 AS STRING)) AS chrom,
  (o_orderkey * o_orderkey * 13 + o_custkey * 7919) % 10000019 + 60 AS position
FROM orders WHERE o_orderkey % 37 = 0""",
    "v_pred": """
SELECT d.doc_id AS id, l.toxic AS label, d.source AS grp, d.lang AS category, d.n_chars AS depth,
  m.model_id, CAST((d.doc_id * m.mult + 12345) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.7 AS DOUBLE)
    + CAST(l.toxic AS DOUBLE) * CAST(m.lift AS DOUBLE) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
CROSS JOIN (SELECT 'm0' AS model_id, 7919 AS mult, 0.0 AS lift UNION ALL SELECT 'm1', 104729, 0.2
  UNION ALL SELECT 'm2', 1299709, 0.3) m""",
    "v_tied": """
SELECT id, label, grp, category, depth, model_id, ROUND(score, 1) AS score FROM v_pred""",
    "v_vec": """
SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE 0 END AS label,
  CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'dev' END AS split, embedding FROM embeddings""",
    # A site pool with split, class flags and a unique key, for sampling.
    "v_pool": """
SELECT s.site_id AS id, s.gene_id, s.label, s.chrom, s.position, s.strand, s.seq,
  CASE WHEN s.site_id % 10 < 7 THEN 'train' WHEN s.site_id % 10 = 7 THEN 'dev'
    WHEN s.site_id % 10 = 8 THEN 'calibration' ELSE 'test' END AS split,
  s.site_id % 7 = 0 AS matched, s.site_id % 3 = 0 AS hard, s.site_id % 11 = 0 AS guided
FROM v_site_seq s""",
}


# The same view for Spark with the three models exploded instead of joined.
SPARK_VIEWS = {
    "v_pred": """
SELECT d.doc_id AS id, l.toxic AS label, d.source AS grp, d.lang AS category, d.n_chars AS depth,
  m.model_id, CAST((d.doc_id * m.mult + 12345) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.7 AS DOUBLE)
    + CAST(l.toxic AS DOUBLE) * CAST(m.lift AS DOUBLE) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
LATERAL VIEW inline(array(struct('m0', 7919, 0.0D), struct('m1', 104729, 0.2D), struct('m2', 1299709, 0.3D))) m AS model_id, mult, lift""",
}


def _order(names: list[str]) -> list[str]:
    """The named views and those they use, dependencies first."""
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        seen.append(name)

    for name in names:
        visit(name)
    return seen


def used_in(sql: str) -> list[str]:
    return _order([v for v in VIEWS if re.search(rf"\b{v}\b", sql)])


def oracle(sql: str) -> str:
    """The query text with the views it uses as leading common table expressions."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used_in(sql))
    body = sql.strip()
    recursive = re.match(r"(?i)with\s+recursive\s+", body)
    plain = re.match(r"(?i)with\s+", body)
    if not ctes:
        return body
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{body[recursive.end():]}"
    if plain:
        return f"WITH {ctes},\n{body[plain.end():]}"
    return f"WITH {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the parquet files of ``sf_dir``."""
    chain = _order([name])
    text = f"WITH {', '.join(f'{v} AS ({SPARK_VIEWS.get(v, VIEWS[v])})' for v in chain)} SELECT * FROM {name}"
    tables = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
