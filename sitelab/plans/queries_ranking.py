"""Ranking, classification and calibration metrics for several models at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelab.functions import scoring as S
from sitelab.functions.sequences import base_entropy, gc_fraction
from sitelab.operators import calibrate as C
from sitelab.operators import ranking as R
from sitelab.operators import stats as W
from sitelab.operators.ordering import global_rank, top_k
from sitelab.operators import quality as Y
from sitelab.plans.registry import query

BUDGETS = (10, 50, 100, 500, 1000)

# Oracle fragments. {pred} is v_pred or v_tied.
_RANKED = "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY score DESC, id) AS rank, COUNT(*) OVER (PARTITION BY model_id) AS n FROM {pred})"
_TABLE = """
ties AS (SELECT model_id, score, CAST(SUM(label) AS BIGINT) AS pos, CAST(COUNT(*) - SUM(label) AS BIGINT) AS neg FROM {pred} GROUP BY model_id, score),
tab AS (SELECT *, CAST(SUM(pos) OVER w AS BIGINT) AS tp, CAST(SUM(neg) OVER w AS BIGINT) AS fp, CAST(SUM(pos) OVER m AS BIGINT) AS positives, CAST(SUM(neg) OVER m AS BIGINT) AS negatives
  FROM ties WINDOW w AS (PARTITION BY model_id ORDER BY score DESC), m AS (PARTITION BY model_id)),
steps AS (SELECT *, tp / (tp + fp) AS prec, pos / positives AS gain,
    CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1.0 END AS before FROM tab)"""
_AREAS = (
    _TABLE
    + """,
areas AS (SELECT model_id, SUM(gain * prec) AS average_precision, SUM(gain * (prec + before) / 2) AS pr_auc,
    SUM(pos * (negatives - fp + neg / 2.0)) / (MAX(positives) * MAX(negatives)) AS roc_auc FROM steps GROUP BY model_id)"""
)
_NDCG = (
    _RANKED
    + """,
shares AS (SELECT model_id, score, AVG(1 / LOG2(rank + 1)) AS share, SUM(label) AS gain FROM ranked GROUP BY model_id, score),
dcg AS (SELECT model_id, SUM(share * gain) AS dcg, SUM(gain) AS p FROM shares GROUP BY model_id),
ideal AS (SELECT r.model_id, SUM(1 / LOG2(rank + 1)) AS best FROM ranked r JOIN dcg ON dcg.model_id = r.model_id WHERE rank <= p GROUP BY r.model_id),
gains AS (SELECT d.model_id, dcg / best AS ndcg FROM dcg d JOIN ideal i ON i.model_id = d.model_id)"""
)
_BUDGET = (
    _RANKED
    + """,
budget AS (SELECT model_id, CAST(k AS BIGINT) AS budget, CAST(SUM(CASE WHEN rank <= k THEN label ELSE 0 END) AS BIGINT) AS discovered, MAX(n) AS n, SUM(label) AS p,
    LEAST(k, MAX(n)) AS used FROM ranked CROSS JOIN (VALUES (10), (50), (100), (500), (1000)) b(k) GROUP BY model_id, k),
rates AS (SELECT model_id, budget, discovered, discovered / used AS precision, discovered / p AS recall, discovered / used / (p / n) AS enrichment, p / n AS background_rate FROM budget)"""
)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def sql6(*names):
    return ", ".join(f"ROUND({n}, 6) AS {n}" for n in names)


for _name, _pred in (("", "v_pred"), ("_tied", "v_tied")):

    @query(f"m1_average_precision{_name}", f"WITH {_AREAS.format(pred=_pred)} SELECT model_id, {sql6('average_precision')} FROM areas")
    def _(src, pred=_pred):
        return R.area_metrics(R.score_table(getattr(src, pred))).select("model_id", *r6("average_precision"))

    @query(f"m3_roc_auc{_name}", f"WITH {_AREAS.format(pred=_pred)} SELECT model_id, {sql6('roc_auc')} FROM areas")
    def _(src, pred=_pred):
        return R.area_metrics(R.score_table(getattr(src, pred))).select("model_id", *r6("roc_auc"))

    @query(f"m4_ndcg{_name}", f"WITH {_NDCG.format(pred=_pred)} SELECT model_id, {sql6('ndcg')} FROM gains")
    def _(src, pred=_pred):
        return R.ndcg(R.rank_scores(getattr(src, pred))).select("model_id", *r6("ndcg"))

    _RATES = ("precision", "recall", "enrichment", "background_rate")

    @query(
        f"m5_budget_metrics{_name}",
        f"WITH {_BUDGET.format(pred=_pred)} SELECT model_id, budget, discovered, {sql6(*_RATES)} FROM rates",
    )
    def _(src, pred=_pred, rates=_RATES):
        return R.budget_table(R.rank_scores(getattr(src, pred))).select("model_id", "budget", "discovered", *r6(*rates))


@query("m2_pr_auc", f"WITH {_AREAS.format(pred='v_tied')} SELECT model_id, {sql6('pr_auc')} FROM areas")
def _(src):
    return R.area_metrics(R.score_table(src.v_tied)).select("model_id", *r6("pr_auc"))


_SELECT = (
    "WITH "
    + _AREAS.format(pred="v_pred")
    + ", "
    + _BUDGET.format(pred="v_pred")
    + """, key AS (SELECT model_id, AVG(precision) AS selection_mean_precision_at_k, MAX(precision) FILTER (WHERE budget = 100) AS precision_at_100,
  MAX(precision) FILTER (WHERE budget = 500) AS precision_at_500 FROM rates GROUP BY model_id)"""
)


@query(
    "m6_selection_key",
    _SELECT
    + f" SELECT k.model_id, {sql6('selection_mean_precision_at_k', 'precision_at_100', 'precision_at_500', 'average_precision')} FROM key k JOIN areas a ON a.model_id = k.model_id",
)
def _(src):
    return R.ranking_metrics(src.v_pred).select("model_id", *r6(*R.SELECTION_ORDER))


@query(
    "m14_best_model",
    _SELECT
    + """ SELECT k.model_id, ROUND(average_precision, 6) AS average_precision FROM key k JOIN areas a ON a.model_id = k.model_id
ORDER BY selection_mean_precision_at_k DESC, precision_at_100 DESC, precision_at_500 DESC, average_precision DESC, k.model_id LIMIT 1""",
)
def _(src):
    metrics = R.ranking_metrics(src.v_pred).select("model_id", *R.SELECTION_ORDER)
    return W.best_of_grid(metrics, [], R.SELECTION_ORDER, ["model_id"]).select("model_id", *r6("average_precision"))


@query(
    "m14_best_model_per_category",
    """
WITH ties AS (SELECT category, model_id, score, SUM(label) AS pos, COUNT(*) - SUM(label) AS neg FROM v_pred GROUP BY category, model_id, score),
tab AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER m AS positives FROM ties
  WINDOW w AS (PARTITION BY category, model_id ORDER BY score DESC), m AS (PARTITION BY category, model_id)),
ap AS (SELECT category, model_id, SUM(pos / positives * (tp / (tp + fp))) AS average_precision FROM tab GROUP BY category, model_id),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY average_precision DESC, model_id) AS rn FROM ap)
SELECT category, model_id, ROUND(average_precision, 6) AS average_precision FROM o WHERE rn = 1""",
)
def _(src):
    by = ["category", "model_id"]
    areas = R.area_metrics(R.score_table(src.v_pred, by), by).select(*by, "average_precision")
    return W.best_of_grid(areas, ["category"], ["average_precision"], ["model_id"]).select(*by, *r6("average_precision"))


_CONF = """
conf AS (SELECT model_id, COUNT(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, COUNT(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
  COUNT(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, COUNT(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, AVG((score - label) * (score - label)) AS brier FROM v_pred GROUP BY model_id)"""


@query(
    "m7_confusion_metrics",
    f"""WITH {_CONF} SELECT model_id, tp, fp, fn, tn, ROUND(brier, 6) AS brier, ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, ROUND(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
  ROUND(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / SQRT(CAST((tp + fp) * (tp + fn) AS DOUBLE) * ((tn + fp) * (tn + fn))) ELSE 0.0 END, 6) AS mcc,
  ROUND(fp / GREATEST(1, fp + tn) * 1000000.0, 6) AS fp_per_million FROM conf""",
)
def _(src):
    out = R.confusion(src.v_pred, F.lit(0.5))
    return out.select("model_id", "tp", "fp", "fn", "tn", *r6("brier", "precision", "recall", "f1", "mcc", "fp_per_million"))


_ECE = """
cells AS (SELECT model_id, CASE WHEN score BETWEEN 0 AND 1 THEN LEAST(FLOOR(score * 15), 14) END AS c, COUNT(*) AS n, SUM(label) AS y, SUM(score) AS s FROM v_pred GROUP BY ALL),
ece AS (SELECT model_id, SUM(CASE WHEN c IS NOT NULL THEN ABS(y - s) ELSE 0.0 END) / SUM(n) AS ece FROM cells GROUP BY model_id)"""


@query("m8_calibration_error", f"WITH {_ECE} SELECT model_id, ROUND(ece, 6) AS ece FROM ece")
def _(src):
    return R.calibration_error(src.v_pred).select("model_id", *r6("ece"))


@query(
    "m9_reliability_points",
    """
WITH e AS (SELECT model_id, QUANTILE_CONT(score, [1/12, 2/12, 3/12, 4/12, 5/12, 6/12, 7/12, 8/12, 9/12, 10/12, 11/12]) AS edges FROM v_pred GROUP BY model_id)
SELECT p.model_id, CAST(len(list_filter(edges, lambda x: x < score)) AS BIGINT) AS bin, ROUND(AVG(score), 6) AS mean_score, ROUND(AVG(label), 6) AS observed_rate, COUNT(*) AS n
FROM v_pred p JOIN e ON e.model_id = p.model_id GROUP BY p.model_id, bin""",
)
def _(src):
    return R.reliability_points(src.v_pred).select("model_id", "bin", *r6("mean_score", "observed_rate"), "n")


@query(
    "m10_curve_points",
    f"""WITH {_TABLE.format(pred='v_tied')} SELECT model_id, score, tp, fp, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / positives, 6) AS recall, ROUND(fp / negatives, 6) AS fpr FROM tab""",
)
def _(src):
    return R.curve_points(R.score_table(src.v_tied)).select("model_id", "score", "tp", "fp", *r6("precision", "recall", "fpr"))


@query(
    "m11_leaderboard",
    "WITH "
    + _AREAS.format(pred="v_pred")
    + ", "
    + _BUDGET.format(pred="v_pred")
    + f"""SELECT CASE a.model_id WHEN 'm0' THEN 'Random ranking' ELSE 'Model ' || a.model_id END AS display, a.model_id, {sql6('average_precision', 'pr_auc', 'roc_auc')},
  ROUND(MAX(precision) FILTER (WHERE budget = 10), 6) AS precision_at_10, ROUND(MAX(recall) FILTER (WHERE budget = 100), 6) AS recall_at_100,
  ROUND(MAX(enrichment) FILTER (WHERE budget = 100), 6) AS enrichment_at_100
FROM areas a JOIN rates r ON r.model_id = a.model_id GROUP BY ALL""",
)
def _(src):
    display = F.when(F.col("model_id") == "m0", "Random ranking").otherwise(F.concat(F.lit("Model "), "model_id"))
    return R.ranking_metrics(src.v_pred).select(
        display.alias("display"), "model_id",
        *r6("average_precision", "pr_auc", "roc_auc", "precision_at_10", "recall_at_100", "enrichment_at_100"),
    )


_CUT = (
    _RANKED.format(pred="v_tied")
    + """,
goal AS (SELECT r.model_id, CAST(k AS BIGINT) AS budget, score AS cutoff FROM ranked r CROSS JOIN (VALUES (10), (50), (100), (500), (1000)) b(k) WHERE rank = LEAST(k, n)),
reach AS (SELECT g.model_id, budget, cutoff, COUNT(*) FILTER (WHERE r.score >= cutoff) AS at_or_above FROM goal g JOIN ranked r ON r.model_id = g.model_id GROUP BY ALL)"""
)


@query("c6_budget_cutoffs", f"WITH {_CUT} SELECT model_id, budget, ROUND(cutoff, 6) AS cutoff, at_or_above FROM reach")
def _(src):
    return R.budget_cutoffs(R.rank_scores(src.v_tied)).select("model_id", "budget", *r6("cutoff"), "at_or_above")


@query(
    "m12_threshold_strategies",
    f"""WITH {_CUT}, frozen AS (SELECT model_id, budget, cutoff FROM reach),
held AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY score DESC, id) AS hr FROM v_pred),
x AS (SELECT f.model_id, budget, cutoff, label, score >= cutoff AS above, hr FROM held h JOIN frozen f ON f.model_id = h.model_id)
SELECT model_id, budget, 'Top-K only' AS strategy, budget AS selected, CAST(SUM(CASE WHEN hr <= budget THEN label ELSE 0 END) AS BIGINT) AS discovered, CAST(NULL AS DOUBLE) AS threshold FROM x GROUP BY model_id, budget, cutoff
UNION ALL SELECT model_id, budget, 'score threshold', COUNT(*) FILTER (WHERE above), CAST(SUM(CASE WHEN above THEN label ELSE 0 END) AS BIGINT), ROUND(cutoff, 6) FROM x GROUP BY model_id, budget, cutoff
UNION ALL SELECT model_id, budget, 'threshold + Top-K', COUNT(*) FILTER (WHERE above AND hr <= budget), CAST(SUM(CASE WHEN above AND hr <= budget THEN label ELSE 0 END) AS BIGINT), ROUND(cutoff, 6) FROM x GROUP BY model_id, budget, cutoff""",
)
def _(src):
    cutoffs = R.budget_cutoffs(R.rank_scores(src.v_tied))
    out = R.threshold_strategies(R.rank_scores(src.v_pred), cutoffs)
    return out.withColumn("threshold", F.round("threshold", 6))


@query(
    "m13_correlations",
    """
WITH r AS (SELECT model_id, score, depth, RANK() OVER (PARTITION BY model_id ORDER BY score) + (COUNT(*) OVER (PARTITION BY model_id, score) - 1) / 2.0 AS a,
  RANK() OVER (PARTITION BY model_id ORDER BY depth) + (COUNT(*) OVER (PARTITION BY model_id, depth) - 1) / 2.0 AS b FROM v_tied)
SELECT model_id, ROUND(CORR(score, depth), 6) AS pearson, ROUND(CORR(a, b), 6) AS spearman FROM r GROUP BY model_id""",
)
def _(src):
    return W.correlations(src.v_tied, ["model_id"], "score", "depth").select("model_id", *r6("pearson", "spearman"))


#: Each model's score against features of the rows.
_FEATURES = {"depth": "depth", "group_number": "CAST(substr(grp, 4) AS BIGINT)", "wave": "(id * 37) % 101"}
_LONG = " UNION ALL ".join(f"SELECT model_id, id, label, score, '{name}' AS feature, CAST({x} AS DOUBLE) AS x FROM v_pred" for name, x in _FEATURES.items())


@query(
    "m13_shortcut_bias",
    # The p-value by Simpson's rule over the density of a correlation of independent pairs.
    f"""WITH {_BUDGET.format(pred='v_pred')}, l AS ({_LONG}),
k AS (SELECT model_id, feature, RANK() OVER (PARTITION BY model_id, feature ORDER BY score) + (COUNT(*) OVER (PARTITION BY model_id, feature, score) - 1) / 2.0 AS a,
  RANK() OVER (PARTITION BY model_id, feature ORDER BY x) + (COUNT(*) OVER (PARTITION BY model_id, feature, x) - 1) / 2.0 AS b FROM l WHERE x IS NOT NULL),
c AS (SELECT model_id, feature, COUNT(*) AS n, CORR(a, b) AS rho FROM k GROUP BY model_id, feature),
s AS (SELECT model_id, feature, n, rho, SUM(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * POWER(1 - POWER(ABS(rho) * i / 2000.0, 2), (n - 4) / 2.0)) * ABS(rho) / 2000 / 3 AS area
  FROM c, range(0, 2001) g(i) GROUP BY model_id, feature, n, rho)
SELECT s.model_id, feature, n, ROUND(rho, 6) AS spearman, ROUND(1 - 2 * area / EXP(LGAMMA(0.5) + LGAMMA((n - 2) / 2.0) - LGAMMA((n - 1) / 2.0)), 6) AS p_value,
  ROUND(e1.enrichment, 6) AS enrichment_at_100, ROUND(e2.enrichment, 6) AS enrichment_at_500
FROM s JOIN rates e1 ON e1.model_id = s.model_id AND e1.budget = 100 JOIN rates e2 ON e2.model_id = s.model_id AND e2.budget = 500""",
)
def _(src):
    """Rank correlation of every model's score with every feature, its p-value, and what the model finds within a budget."""
    pred = src.v_pred
    x = F.array(*[F.struct(F.lit(name).alias("feature"), F.expr(x).cast("double").alias("x")) for name, x in _FEATURES.items()])
    tests = W.correlation_tests(pred.select("model_id", "score", F.inline(x)), ["model_id", "feature"], "score", "x")
    found = R.budget_table(R.rank_scores(pred), budgets=(100, 500))
    enriched = found.groupBy("model_id").agg(*[F.max(F.when(F.col("budget") == k, F.col("enrichment"))).alias(f"enrichment_at_{k}") for k in (100, 500)])
    both = tests.join(enriched, "model_id")
    return both.select("model_id", "feature", "n", *r6("spearman", "p_value", "enrichment_at_100", "enrichment_at_500"))


@query(
    "m15_metric_deltas",
    "WITH "
    + _AREAS.format(pred="v_pred")
    + """SELECT metric, ROUND(delta, 6) AS delta FROM (
  SELECT 'average_precision' AS metric, MAX(average_precision) FILTER (WHERE model_id = 'm2') - MAX(average_precision) FILTER (WHERE model_id = 'm1') AS delta FROM areas
  UNION ALL SELECT 'roc_auc', MAX(roc_auc) FILTER (WHERE model_id = 'm2') - MAX(roc_auc) FILTER (WHERE model_id = 'm1') FROM areas)""",
)
def _(src):
    areas = R.area_metrics(R.score_table(src.v_pred))
    return W.metric_deltas(areas, "model_id", "m1", "m2", ["average_precision", "roc_auc"]).withColumn("delta", F.round("delta", 6))


@query(
    "m16_strongest_pair",
    """
WITH v AS (SELECT vec_id, embedding, vec_id % 97 AS a, (vec_id * 7) % 89 AS b FROM v_vec),
c AS (SELECT i AS component, CORR(embedding[i + 1], a) AS ca, CORR(embedding[i + 1], b) AS cb FROM v, range(0, 64) r(i) GROUP BY i),
l AS (SELECT component, 'a' AS feature, ca AS pearson FROM c UNION ALL SELECT component, 'b', cb FROM c)
SELECT component, feature, ROUND(pearson, 6) AS pearson FROM l ORDER BY ABS(pearson) DESC, component, feature LIMIT 1""",
)
def _(src):
    vec = src.v_vec.select("vec_id", F.posexplode("embedding").alias("component", "x"))
    a, b = F.col("vec_id") % 97, (F.col("vec_id") * 7) % 89
    wide = vec.groupBy("component").agg(
        F.corr(F.col("x").cast("double"), a.cast("double")).alias("a"), F.corr(F.col("x").cast("double"), b.cast("double")).alias("b")
    )
    long = wide.unpivot("component", ["a", "b"], "feature", "pearson")
    return W.strongest_pair(long).select(F.col("component").cast("bigint").alias("component"), "feature", *r6("pearson"))


@query(
    "w8_stable_rank",
    "SELECT id, model_id, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY score DESC, id) AS rank FROM v_tied",
)
def _(src):
    return R.rank_scores(src.v_tied).select("id", "model_id", "rank")


_BEST = """
h AS (SELECT id, model_id, score, md5(CAST(id % 150 AS STRING)) AS sequence_hash FROM v_tied WHERE model_id = 'm1'),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sequence_hash ORDER BY score DESC, id) AS rn FROM h)"""


@query(
    "w9_best_per_sequence",
    f"WITH {_BEST} SELECT id, sequence_hash, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS source_rank FROM best WHERE rn = 1",
)
def _(src):
    rows = src.v_tied.filter("model_id = 'm1'").select("id", "score", F.md5((F.col("id") % 150).cast("string")).alias("sequence_hash"))
    best = R.best_per_sequence(rows, "sequence_hash", "score", "id")
    return global_rank(best, ["-score", "id"], name="source_rank").select("id", "sequence_hash", "source_rank")


@query("k2_top_k", "SELECT id, model_id, ROUND(score, 6) AS score FROM v_tied ORDER BY score DESC, id, model_id LIMIT 100")
def _(src):
    return top_k(src.v_tied, 100, ["-score", "id", "model_id"]).select("id", "model_id", *r6("score"))


@query(
    "k2_top_k_beyond_heap",
    "SELECT site_id, position FROM v_sites ORDER BY position DESC, site_id LIMIT 12000",
)
def _(src):
    return top_k(src.v_sites, 12_000, ["-position", "site_id"]).select("site_id", "position")


@query(
    "j13_model_agreement",
    """
WITH m AS (SELECT id, COUNT(*) AS n, MIN(label) AS a, MAX(label) AS b, COUNT(score) AS s FROM v_pred WHERE NOT (model_id = 'm2' AND id % 50 = 0) GROUP BY id)
SELECT x AS assertion, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, v AS violations FROM (
  SELECT 'every_model_scores_every_id_once' AS x, COUNT(*) FILTER (WHERE n <> 3) AS v FROM m UNION ALL SELECT 'labels_agree', COUNT(*) FILTER (WHERE a <> b) FROM m
  UNION ALL SELECT 'no_missing_score', COUNT(*) FILTER (WHERE s <> n) FROM m)""",
)
def _(src):
    return Y.model_agreement(src.v_pred.filter("NOT (model_id = 'm2' AND id % 50 = 0)"), 3)


@query(
    "j13_wide_predictions",
    """SELECT id, MAX(label) AS label, ROUND(MAX(score) FILTER (WHERE model_id = 'm0'), 6) AS m0, ROUND(MAX(score) FILTER (WHERE model_id = 'm1'), 6) AS m1,
  ROUND(MAX(score) FILTER (WHERE model_id = 'm2'), 6) AS m2 FROM v_pred GROUP BY id""",
)
def _(src):
    wide = src.v_pred.groupBy("id", "label").pivot("model_id", ["m0", "m1", "m2"]).agg(F.max("score"))
    return wide.select("id", "label", *r6("m0", "m1", "m2"))


@query(
    "a14_split_label_counts",
    "SELECT split, label, COUNT(*) AS rows FROM v_pool GROUP BY split, label",
)
def _(src):
    return src.v_pool.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a16_seed_summary",
    """
WITH m AS (SELECT grp AS model_type, CASE model_id WHEN 'm0' THEN 42 WHEN 'm1' THEN 43 ELSE 44 END AS seed, AVG(score) AS mean_score, AVG(score * label) AS hit FROM v_pred GROUP BY grp, model_id)
SELECT model_type, COUNT(*) AS seed_count, """
    + ", ".join(
        f"ROUND(AVG({m}), 6) AS {m}_mean, ROUND(STDDEV_SAMP({m}), 6) AS {m}_sd, ROUND(STDDEV_POP({m}), 6) AS {m}_sd_population, ROUND(MAX({m}) FILTER (WHERE seed = 42), 6) AS {m}_deployed"
        for m in ("mean_score", "hit")
    )
    + " FROM m GROUP BY model_type",
)
def _(src):
    seed = F.when(F.col("model_id") == "m0", 42).when(F.col("model_id") == "m1", 43).otherwise(44)
    metrics = src.v_pred.groupBy(F.col("grp").alias("model_type"), seed.alias("seed")).agg(
        F.avg("score").alias("mean_score"), F.avg(F.col("score") * F.col("label")).alias("hit")
    )
    out = W.seed_summary(metrics, "model_type", "seed", ["mean_score", "hit"], 42)
    return out.select("model_type", "seed_count", *r6(*[c for c in out.columns if c not in ("model_type", "seed_count")]))


_SUBGROUP = """
b AS (SELECT QUANTILE_CONT(depth, 1/3) AS lo, QUANTILE_CONT(depth, 2/3) AS hi FROM v_pred WHERE model_id = 'm0'),
x AS (SELECT id, label, score, 'depth' AS field, CASE WHEN depth <= lo THEN 'low' WHEN depth <= hi THEN 'medium' ELSE 'high' END AS grp FROM v_pred, b WHERE model_id = 'm1'
  UNION ALL SELECT id, label, score, 'category', category FROM v_pred WHERE model_id = 'm1' UNION ALL SELECT id, label, score, 'source', grp FROM v_pred WHERE model_id = 'm1'),
big AS (SELECT field, grp, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positive, AVG(score) AS mean_score FROM x GROUP BY field, grp HAVING COUNT(*) >= 20),
ties AS (SELECT field, grp, score, SUM(label) AS pos, COUNT(*) - SUM(label) AS neg FROM x GROUP BY field, grp, score),
tab AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER m AS positives FROM ties WINDOW w AS (PARTITION BY field, grp ORDER BY score DESC), m AS (PARTITION BY field, grp)),
ap AS (SELECT field, grp, SUM(pos / positives * (tp / (tp + fp))) AS average_precision FROM tab WHERE positives > 0 GROUP BY field, grp)"""


@query(
    "a17_subgroup_metrics",
    f"""WITH {_SUBGROUP} SELECT b.field, b.grp, n, positive, ROUND(mean_score, 6) AS mean_score, ROUND(CASE WHEN positive > 0 AND positive < n THEN average_precision END, 6) AS average_precision
FROM big b LEFT JOIN ap ON ap.field = b.field AND ap.grp = b.grp""",
)
def _(src):
    bounds = W.quantiles(src.v_pred.filter("model_id = 'm0'"), [], ["depth"], [1 / 3, 2 / 3]).orderBy("level").collect()
    low, high = (F.lit(r["value"]) for r in bounds)
    rows = src.v_pred.filter("model_id = 'm1'")
    fields = {"depth": R.tertile("depth", low, high), "category": F.col("category"), "source": F.col("grp")}
    long = R.subgroup_rows(rows, fields, 20)
    by = ["field", "grp"]
    counts = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positive"), F.avg("score").alias("mean_score")
    )
    areas = R.area_metrics(R.score_table(long, by), by)
    both = (F.col("positive") > 0) & (F.col("positive") < F.col("n"))
    joined = counts.join(areas.select(*by, "average_precision"), by, "left")
    return joined.select(*by, "n", "positive", *r6("mean_score"), F.round(F.when(both, F.col("average_precision")), 6).alias("average_precision"))


@query(
    "a18_distinct_counts",
    "SELECT chrom, COUNT(DISTINCT gene_id) AS genes, COUNT(DISTINCT substr(raw_seq, 49, 5)) AS motifs, COUNT(DISTINCT position) AS positions FROM v_sites GROUP BY chrom",
)
def _(src):
    # One distinct set after another: each is reduced on the map side.
    return src.v_sites.groupBy("chrom").agg(
        F.countDistinct("gene_id").alias("genes"),
        F.countDistinct(F.substring("raw_seq", 49, 5)).alias("motifs"),
        F.countDistinct("position").alias("positions"),
    )


@query(
    "a19_quantiles",
    """
SELECT model_id, field, level, ROUND(value, 6) AS value FROM (
  SELECT model_id, 'score' AS field, l AS level, QUANTILE_CONT(score, 0.05) FILTER (WHERE l = 0.05) AS a, QUANTILE_CONT(score, 0.25) FILTER (WHERE l = 0.25) AS b, QUANTILE_CONT(score, 0.95) FILTER (WHERE l = 0.95) AS c,
    COALESCE(QUANTILE_CONT(score, 0.05) FILTER (WHERE l = 0.05), QUANTILE_CONT(score, 0.25) FILTER (WHERE l = 0.25), QUANTILE_CONT(score, 0.95) FILTER (WHERE l = 0.95)) AS value
  FROM v_pred, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) v(l) GROUP BY model_id, l
  UNION ALL SELECT model_id, 'depth', l, NULL, NULL, NULL,
    COALESCE(QUANTILE_CONT(CAST(depth AS DOUBLE), 0.05) FILTER (WHERE l = 0.05), QUANTILE_CONT(CAST(depth AS DOUBLE), 0.25) FILTER (WHERE l = 0.25), QUANTILE_CONT(CAST(depth AS DOUBLE), 0.95) FILTER (WHERE l = 0.95))
  FROM v_pred, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) v(l) GROUP BY model_id, l)""",
)
def _(src):
    return W.quantiles(src.v_pred, ["model_id"], ["score", "depth"], [0.05, 0.25, 0.95]).withColumn("value", F.round("value", 6))


@query(
    "a21_threshold_summary",
    """SELECT model_id, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_score, ROUND(MEDIAN(score), 6) AS median_score, COUNT(*) FILTER (WHERE score >= 0.6) AS predicted_positive,
  ROUND(COUNT(*) FILTER (WHERE score >= 0.6) / COUNT(*) * 1000000.0, 6) AS fp_per_million FROM v_pred WHERE label = 0 GROUP BY model_id""",
)
def _(src):
    n, hit = F.count(F.lit(1)), F.count_if(F.col("score") >= 0.6)
    negatives = src.v_pred.filter("label = 0")
    middle = W.quantiles(negatives, ["model_id"], ["score"], [0.5]).select("model_id", F.round("value", 6).alias("median_score"))
    return negatives.groupBy("model_id").agg(
        n.alias("n"), F.round(F.avg("score"), 6).alias("mean_score"),
        hit.alias("predicted_positive"), F.round(hit / n * 1_000_000.0, 6).alias("fp_per_million"),
    ).join(middle, "model_id")


_FPB = """
neg AS (SELECT model_id, score, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY score DESC) AS rn, COUNT(*) OVER (PARTITION BY model_id) AS n FROM v_tied WHERE label = 0),
goal AS (SELECT DISTINCT model_id, CAST(t AS BIGINT) AS target_fp_per_million, CAST(FLOOR(t * n / 1000000.0) AS BIGINT) AS allowed_fp, n FROM neg, (VALUES (10), (1000), (50000), (200000), (1000000)) v(t)),
lim AS (SELECT g.*, s.score AS exceed_score FROM goal g LEFT JOIN neg s ON s.model_id = g.model_id AND s.rn = g.allowed_fp + 1)"""


@query(
    "c5_fp_budget_threshold",
    f"""WITH {_FPB} SELECT l.model_id, target_fp_per_million, allowed_fp, ROUND(exceed_score, 6) AS exceed_score,
  COUNT(*) FILTER (WHERE label = 1 AND (exceed_score IS NULL OR score > exceed_score)) AS tp, COUNT(*) FILTER (WHERE label = 0 AND (exceed_score IS NULL OR score > exceed_score)) AS fp
FROM lim l JOIN v_tied p ON p.model_id = l.model_id GROUP BY ALL""",
)
def _(src):
    out = R.fp_budget_threshold(src.v_tied, [10, 1000, 50000, 200000, 1000000])
    return out.select("model_id", "target_fp_per_million", "allowed_fp", *r6("exceed_score"), "tp", "fp")


@query(
    "c4_method_choice",
    """
WITH m AS (SELECT model_id, 'raw' AS method, score, label FROM v_pred UNION ALL SELECT model_id, 'squared', score * score, label FROM v_pred UNION ALL SELECT model_id, 'half', score / 2, label FROM v_pred),
b AS (SELECT model_id, method, AVG((score - label) * (score - label)) AS brier FROM m GROUP BY model_id, method),
c AS (SELECT model_id, method, CASE WHEN score BETWEEN 0 AND 1 THEN LEAST(FLOOR(score * 15), 14) END AS c, COUNT(*) AS n, SUM(label) AS y, SUM(score) AS s FROM m GROUP BY ALL),
e AS (SELECT model_id, method, SUM(CASE WHEN c IS NOT NULL THEN ABS(y - s) ELSE 0.0 END) / SUM(n) AS ece FROM c GROUP BY model_id, method),
o AS (SELECT b.model_id, b.method, brier, ROW_NUMBER() OVER (PARTITION BY b.model_id ORDER BY brier, ece, b.method) AS rn FROM b JOIN e ON e.model_id = b.model_id AND e.method = b.method)
SELECT model_id, method, ROUND(brier, 6) AS brier FROM o WHERE rn = 1""",
)
def _(src):
    s = F.col("score")
    forms = F.array(
        *[F.struct(F.lit(n).alias("method"), v.alias("value")) for n, v in (("raw", s), ("squared", s * s), ("half", s / 2))]
    )
    long = src.v_pred.select("model_id", "label", F.inline(forms)).withColumnRenamed("value", "score")
    by = ["model_id", "method"]
    table = R.confusion(long, F.lit(0.5), by).select(*by, "brier").join(R.calibration_error(long, by), by)
    return C.choose_method(table, ["model_id"]).select("model_id", "method", *r6("brier"))


_ERR = f"""
WITH f AS (SELECT p.id, p.label, p.model_id, p.score, p.depth, q.seq, (p.id % 40) / 100.0 AS eff, length(replace(replace(q.seq, 'A', ''), 'T', '')) / 101.0 AS gc,
    length(q.seq) - length(replace(q.seq, 'C', '')) AS c_count FROM v_pred p JOIN v_seq q ON q.site_id = p.id + 1)"""


@query(
    "f19_missed_positive_categories",
    _ERR
    + """, b AS (SELECT QUANTILE_CONT(depth, 1/3) AS low_depth FROM f WHERE model_id = 'm1'),
top AS (SELECT DISTINCT substr(seq, 50, 3) AS motif FROM (SELECT * FROM f WHERE model_id = 'm1' AND label = 0 ORDER BY score DESC, id LIMIT 100)),
e AS (SELECT * FROM f WHERE model_id = 'm1' AND label = 1 AND score < 0.55)
SELECT id, CASE WHEN eff <= 0.15 THEN 'low_efficiency_positive' WHEN depth <= low_depth THEN 'coverage_related'
  WHEN substr(seq, 50, 3) IN (SELECT motif FROM top) THEN 'special_motif' ELSE 'other' END AS category FROM e, b""",
)
def _(src):
    rows = _error_rows(src).filter("model_id = 'm1'")
    low = W.quantiles(rows, [], ["depth"], [1 / 3]).first()["value"]
    top = top_k(rows.filter("label = 0"), 100, ["-score", "id"]).select(F.substring("seq", 50, 3).alias("motif")).distinct()
    missed = rows.filter("label = 1 AND score < 0.55").withColumn("motif", F.substring("seq", 50, 3))
    missed = missed.join(top.withColumn("_seen", F.lit(True)), "motif", "left")
    category = S.missed_positive_category(
        F.col("eff"), F.col("depth"), base_entropy("seq"), F.col("_seen").isNotNull(), F.lit(low), F.lit(0.0)
    )
    return missed.select("id", category.alias("category"))


def _error_rows(src):
    joined = src.v_pred.join(src.v_seq.select((F.col("site_id") - 1).alias("id"), "seq"), "id")
    return joined.select(
        "id", "label", "model_id", "score", "depth", "seq", ((F.col("id") % 40) / 100.0).alias("eff"),
        gc_fraction("seq").alias("gc"), F.length(F.replace("seq", F.lit("C"), F.lit(""))).alias("_n"),
    ).withColumn("c_count", F.length("seq") - F.col("_n")).drop("_n")


@query(
    "k12_ranked_errors",
    _ERR
    + """, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS rank, COUNT(*) OVER () AS total FROM f WHERE model_id = 'm2'),
a AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS audit_rank FROM f WHERE model_id = 'm0'),
pos AS (SELECT * FROM r WHERE label = 1 AND id % 2 = 0),
bounds AS (SELECT QUANTILE_CONT(eff, 0.25) AS q25, QUANTILE_CONT(gc, 0.05) AS g1, QUANTILE_CONT(gc, 0.95) AS g2, QUANTILE_CONT(c_count, 0.05) AS c1, QUANTILE_CONT(c_count, 0.95) AS c2 FROM pos),
scale AS (SELECT MAX(score) FILTER (WHERE rank = 100) AS cutoff, GREATEST(QUANTILE_CONT(score, 0.75) - QUANTILE_CONT(score, 0.25), 1e-8) AS width FROM r WHERE rank <= 1000),
picked AS (SELECT * FROM (SELECT *, 'false_positive' AS kind FROM r WHERE label = 0 ORDER BY rank LIMIT 100) UNION ALL SELECT * FROM (SELECT *, 'false_negative' FROM r WHERE label = 1 ORDER BY rank DESC LIMIT 100))
SELECT p.id, kind, rank, CASE WHEN label = 1 AND eff <= q25 THEN 'low efficiency positive' WHEN substr(seq, 49, 5) IN (SELECT substr(seq, 49, 5) FROM pos) THEN 'motif similar'
  WHEN ABS(score - cutoff) <= width * 0.10 THEN 'boundary cases'
  WHEN gc < g1 OR gc > g2 OR c_count < c1 OR c_count > c2 OR (rank <= GREATEST(1000, FLOOR(total * 0.01)) AND audit_rank > total * 0.5) THEN 'sequence pattern failure' ELSE 'other' END AS category
FROM picked p JOIN a ON a.id = p.id, bounds, scale""",
)
def _(src):
    rows = _error_rows(src)
    ranked = global_rank(rows.filter("model_id = 'm2'"), ["-score", "id"])
    audit = global_rank(rows.filter("model_id = 'm0'"), ["-score", "id"], name="audit_rank").select("id", "audit_rank")
    known = ranked.filter("label = 1 AND id % 2 = 0")
    # A handful of frozen numbers, as a deployed policy would hold them.
    bound = {(r["field"], r["level"]): r["value"] for r in W.quantiles(known, [], ["eff", "gc", "c_count"], [0.05, 0.25, 0.95]).collect()}
    near = ranked.filter("rank <= 1000")
    frozen = near.agg(
        F.max(F.when(F.col("rank") == 100, F.col("score"))).alias("cutoff"),
        (F.percentile("score", F.lit(0.75)) - F.percentile("score", F.lit(0.25))).alias("width"),
    ).first()
    total = ranked.count()
    picked = (
        top_k(ranked.filter("label = 0"), 100, ["rank"]).withColumn("kind", F.lit("false_positive"))
    ).unionByName(top_k(ranked.filter("label = 1"), 100, ["-rank"]).withColumn("kind", F.lit("false_negative")))
    motifs = known.select(F.substring("seq", 49, 5).alias("motif")).distinct().withColumn("_seen", F.lit(True))
    joined = picked.withColumn("motif", F.substring("seq", 49, 5)).join(motifs, "motif", "left").join(audit, "id")
    outside = F.lit(False)
    for name in ("gc", "c_count"):
        outside = outside | (F.col(name) < bound[(name, 0.05)]) | (F.col(name) > bound[(name, 0.95)])
    category = S.ranked_error_category(
        F.col("label"), F.col("eff"), F.lit(bound[("eff", 0.25)]), F.col("_seen").isNotNull(), F.col("score"),
        F.lit(frozen["cutoff"]), F.lit(max(frozen["width"], 1e-8)), outside, F.col("rank"), F.col("audit_rank"), F.lit(total),
    )
    return joined.select("id", "kind", "rank", category.alias("category"))


@query(
    "k12_false_calls_at_threshold",
    "SELECT id, model_id, label, ROUND(score, 6) AS score, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS call FROM v_pred WHERE (label = 0 AND score >= 0.65) OR (label = 1 AND score < 0.65)",
)
def _(src):
    wrong = ((F.col("label") == 0) & (F.col("score") >= 0.65)) | ((F.col("label") == 1) & (F.col("score") < 0.65))
    call = F.when(F.col("label") == 0, "FP").otherwise("FN")
    return src.v_pred.filter(wrong).select("id", "model_id", "label", *r6("score"), call.alias("call"))
