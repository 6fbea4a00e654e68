"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate.

The spread of a line is the number of distinct sources whose documents hold it. Each
line hash gathers a HyperLogLog sketch of its sources by partial aggregation; lines
whose estimate lies within a factor of the threshold get an exact distinct count, so
the sketch alone decides only where its error cannot matter. Of a line that reaches
the threshold one occurrence stays: the first in the document with the smallest
doc_id. So no content goes altogether, and of a document copied to many sites the
first copy stays whole.

Every line with a word counts, however short; lines are compared after trimming white
space (blank, tab, line ends, vertical tab, form feed) at both ends. Blank lines stay. A
NULL source counts as one site. A NULL text stays NULL, an empty text empty; a document
may end up empty but is never dropped. An empty table gives no rows. A very long text is
one row of lines while it is cut. Rows with a NULL doc_id come last when the occurrence that stays is chosen.
A row is known by its doc_id and its text, so rows that share a doc_id, or have none,
lose lines by their own text only. Repeated rows with equal doc_id and text keep the
line in each of them. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import ROW_KEY, let, packed, row_key, stored, table, unpacked
from sitelab.llm.registry import query

MIN_SITES = 5
#: Fixed value: the white space that is no part of a line.
WHITE = " \t\n\x0b\x0c\r"
#: Lines with an estimate between threshold / BAND and threshold * BAND are counted exactly.
BAND = 2.0
LG_K = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, ta, tb, site, at, a, b): the lines that are not blank, ``a`` and ``b`` being 128 bits of the trimmed line."""
    site = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("none"))
    # The row's hashes are taken below the explosion, once a row.
    rows = docs.select(*row_key(), site.alias("site"), _lines(F.col("text")).alias("_all"))
    exploded = rows.select(*ROW_KEY, "site", F.posexplode("_all").alias("at", "line"))
    plain = exploded.withColumn("line", F.btrim("line", F.lit(WHITE))).filter("line <> ''")
    return plain.select(*ROW_KEY, "site", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(a, b, sites, exact, doc, ta, tb, at): lines of at least ``min_sites`` sites and the occurrence that stays."""
    rows = line_rows(docs)
    sketched = rows.groupBy("a", "b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"),
        F.min(F.struct(*ROW_KEY, "at")).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    # A line seen fewer than min_sites times cannot reach the threshold: most end here.
    sketched = stored(sketched.filter((F.col("n") >= min_sites) & (F.col("estimate") >= min_sites / band)), "line-sketch")
    near = sketched.filter(F.col("estimate") <= min_sites * band).select("a", "b")
    exact = (
        rows.join(near, ["a", "b"], "left_semi")
        .groupBy("a", "b", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("a", "b")
        .agg(F.count("one").alias("sites"))
    )
    joined = sketched.join(exact, ["a", "b"], "left")
    return joined.select(
        "a",
        "b",
        F.coalesce("sites", "estimate").alias("sites"),
        F.col("sites").isNotNull().alias("exact"),
        *[F.col(f"first.{c}").alias(c) for c in (*ROW_KEY, "at")],
    ).filter(F.col("sites") >= min_sites)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(_row, doc_id, text, removed): cleaned text and the number of lines taken out; _row is the row as it was.

    Only the places of the lines to remove travel; they meet the texts by row identity.
    """
    found = stored(boilerplate(docs, min_sites, band), "line-boilerplate").select(
        "a", "b", F.struct(*ROW_KEY, "at").alias("_first")
    )
    hits = line_rows(docs).join(found, ["a", "b"])
    gone = hits.filter(F.struct(*ROW_KEY, "at") != F.col("_first"))
    places = gone.groupBy(*ROW_KEY).agg(F.sort_array(F.collect_set("at")).alias("_gone"))
    keyed = packed(docs, "doc_id", "text").select("*", *row_key())
    joined = keyed.join(places, list(ROW_KEY), "left")
    # Set difference of positions: linear in the lines, however many go.
    lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = let(lines, lambda all_: F.transform(left, lambda i: F.get(all_, i)))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("_row", "doc_id", text.alias("text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("removed"))


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with cleaned text; a column n_chars follows the text."""
    cleaned = dedup_lines(docs, **options)
    return unpacked(cleaned, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce('=' || source, 'none') AS site, string_split(text, chr(10)) AS parts
  FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut
), counted AS (
  SELECT * FROM (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l) WHERE k <> ''
), spread AS (
  SELECT k, min(struct_pack(d := doc_id, p := pos)) AS first
  FROM counted GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}
), gone AS (
  SELECT c.doc_id, c.pos FROM counted c JOIN spread s ON c.k = s.k
  WHERE struct_pack(d := c.doc_id, p := c.pos) <> s.first
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY l.doc_id
), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_removed, length(coalesce(k.text, ''))::BIGINT AS n_chars_left,
  sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
"""


@query("op9_line_dedup", SQL)
def op9(spark, sf_dir) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        F.col("removed").cast("long").alias("n_removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
