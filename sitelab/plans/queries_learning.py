"""Calibration fits, linear models, centroid scores, pooling and mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelab.functions.scoring import hash_uniform
from sitelab.functions.sequences import base_count, base_entropy, gc_fraction
from sitelab.operators import calibrate as C
from sitelab.operators import learn as N
from sitelab.operators import ranking as R
from sitelab.operators import splits as P
from sitelab.operators import stats as W
from sitelab.plans import flows
from sitelab.plans.queries_ranking import _AREAS
from sitelab.plans.queries_scalars import _entropy
from sitelab.plans.registry import query
from sitelab.session import cut, new_path
from sitelab.sources.frozen import Frozen, freeze_calibrators, freeze_thresholds, freeze_weights


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _half(src, even: bool):
    return src.v_pred.filter(f"id % 2 = {0 if even else 1}")


def _platt_sql(data: str, steps: int = 15) -> str:
    """CTE n(it, m, a, b): Newton steps for slope a and intercept b of every fit m over ``data`` (m, x, y)."""
    return f"""
n(it, m, a, b) AS (
  SELECT 0, m, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM {data} GROUP BY m
  UNION ALL
  SELECT it + 1, m, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
    SELECT it, m, a, b, SUM(x * (y - p)) - a * 1e-6 AS g1, SUM(y - p) AS g2, SUM(x * x * p * (1 - p)) + 1e-6 AS h11, SUM(x * p * (1 - p)) AS h12, SUM(p * (1 - p)) AS h22
    FROM (SELECT n.it, n.m, n.a, n.b, d.x, d.y, 1 / (1 + EXP(-(n.a * d.x + n.b))) AS p FROM n JOIN {data} d ON d.m = n.m) GROUP BY it, m, a, b)
  WHERE it < {steps})"""


def _isotonic_sql(data: str) -> str:
    """CTE pts(m, x, p): the monotone least-squares fit of every m over ``data`` (m, x, y) in closed form: max over starts of the min over ends of the mean."""
    return f"""
iso_d AS MATERIALIZED (SELECT m, x, AVG(y) AS y, COUNT(*) AS w FROM {data} GROUP BY m, x),
iso_o AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY m ORDER BY x) AS i, SUM(y * w) OVER (PARTITION BY m ORDER BY x) AS sy, SUM(w) OVER (PARTITION BY m ORDER BY x) AS sw FROM iso_d),
iso_m AS (SELECT a.m, a.i AS j, b.i AS k, (b.sy - a.sy + a.y * a.w) / (b.sw - a.sw + a.w) AS mean FROM iso_o a JOIN iso_o b ON b.m = a.m AND b.i >= a.i),
iso_lo AS (SELECT m, j, k, MIN(mean) OVER (PARTITION BY m, j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM iso_m),
pts AS MATERIALIZED (SELECT o.m, o.x, MAX(v) AS p FROM iso_lo l JOIN iso_o o ON o.m = l.m AND o.i = l.k GROUP BY o.m, o.x)"""


def _between_sql(rows: str, columns: str) -> str:
    """Rows (m, x, ...) with p: the fit between its neighbouring points, the outer ones beyond them."""
    return f"""SELECT {columns}, CASE WHEN l.x IS NULL THEN h.p WHEN h.x IS NULL OR l.x = r.x THEN l.p ELSE l.p + (h.p - l.p) * (r.x - l.x) / (h.x - l.x) END AS p
  FROM {rows} r ASOF LEFT JOIN pts l ON l.m = r.m AND l.x <= r.x ASOF LEFT JOIN pts h ON h.m = r.m AND h.x >= r.x"""


_CLIPPED = "LEAST(GREATEST(score, 1e-7), 1 - 1e-7)"


@query(
    "c1_platt_calibration",
    f"""
WITH RECURSIVE q AS (SELECT id, model_id, label, score, {_CLIPPED} AS c FROM v_pred),
d AS (SELECT id, model_id || '_logit' AS m, LN(c / (1 - c)) AS x, label AS y FROM q UNION ALL SELECT id, model_id || '_raw', score, label FROM q),
{_platt_sql("d")},
f AS (SELECT d.m AS model_id, a > 0 AS increasing, 1 / (1 + EXP(-(a * x + b))) AS p, y FROM d JOIN n ON n.m = d.m AND n.it = 15)
SELECT model_id, increasing, COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, ROUND(AVG((p - y) * (p - y)), 4) AS brier FROM f GROUP BY ALL""",
)
def _(src):
    rows = src.v_pred.select("id", "model_id", "label", "score")
    out = None
    for on_logit in (True, False):
        fitted = C.fit_platt(rows, on_logit=on_logit, by=["model_id"])
        rising = fitted.fits.select("model_id", (F.col("slope") > 0).alias("increasing"))
        part = fitted.apply(rows, "score", "score").join(rising, "model_id")
        part = part.withColumn("model_id", F.concat("model_id", F.lit("_logit" if on_logit else "_raw")))
        out = part if out is None else out.unionByName(part)
    return R.confusion(out, F.lit(0.5), ["model_id", "increasing"]).select("model_id", "increasing", "tp", "fp", F.round("brier", 4).alias("brier"))


@query(
    "c2_isotonic_calibration",
    f"""WITH t AS (SELECT id, model_id AS m, label, score, {_CLIPPED} AS x, label AS y FROM v_pred), {_isotonic_sql("t")}
SELECT id, t.m AS model_id, label, ROUND(score, 6) AS score, ROUND(p, 6) AS probability FROM t JOIN pts USING (m, x)""",
)
def _(src):
    rows = src.v_pred.select("id", "model_id", "label", "score")
    fitted = C.fit_isotonic(rows, by=["model_id"])
    return C.apply_method(rows, "isotonic", fitted, "score", "probability").select("id", "model_id", "label", *r6("score", "probability"))


@query(
    "c3_out_of_fold_comparison",
    f"""
WITH RECURSIVE unit AS (SELECT DISTINCT id, label, grp FROM v_pred),
size AS (SELECT grp, COUNT(*) AS total, COUNT(*) FILTER (WHERE label = 1) AS positive FROM unit GROUP BY grp),
turn AS (SELECT grp, (ROW_NUMBER() OVER (ORDER BY positive DESC, total DESC, sha256('42|fold|' || grp), grp) - 1) % 10 AS t FROM size),
dealt AS (SELECT id, CASE WHEN t < 5 THEN t ELSE 9 - t END AS fold FROM unit JOIN turn USING (grp)),
r AS MATERIALIZED (SELECT model_id, p.id, label, fold, {_CLIPPED} AS c FROM v_pred p JOIN dealt d ON d.id = p.id),
it AS MATERIALIZED (SELECT model_id || '/' || f AS m, c AS x, label AS y FROM r, range(0, 5) g(f) WHERE f <> fold),
pt AS MATERIALIZED (SELECT m, LN(x / (1 - x)) AS x, y FROM it),
{_platt_sql("pt")}, {_isotonic_sql("it")},
probe AS (SELECT *, model_id || '/' || fold AS m, c AS x FROM r),
oof AS (SELECT model_id, 'none' AS method, label, c AS p FROM r
  UNION ALL SELECT model_id, 'platt', label, 1 / (1 + EXP(-(a * LN(c / (1 - c)) + b))) FROM probe JOIN n ON n.m = probe.m AND n.it = 15
  UNION ALL {_between_sql("probe", "r.model_id, 'isotonic', r.label")}),
cells AS (SELECT model_id, method, CASE WHEN p BETWEEN 0 AND 1 THEN LEAST(FLOOR(p * 15), 14) END AS c, COUNT(*) AS n, SUM(label) AS y, SUM(p) AS s FROM oof GROUP BY ALL),
ece AS (SELECT model_id, method, SUM(CASE WHEN c IS NOT NULL THEN ABS(y - s) ELSE 0.0 END) / SUM(n) AS ece FROM cells GROUP BY model_id, method),
b AS (SELECT model_id, method, AVG((p - label) * (p - label)) AS brier FROM oof GROUP BY model_id, method)
SELECT model_id, method, ROUND(brier, 6) AS brier, ROUND(ece, 6) AS ece FROM b JOIN ece USING (model_id, method)""",
)
def _(src):
    pred = src.v_pred.select("model_id", "id", "label", "score", "grp")
    return flows.calibration_comparison(pred, 5, 42).select("model_id", "method", *r6("brier", "ece"))


@query(
    "c3_row_folds",
    """SELECT id, label, CAST((ROW_NUMBER() OVER (PARTITION BY label ORDER BY sha256('42|fold|' || CAST(id AS STRING)), id) - 1) % 5 AS INTEGER) AS fold
FROM v_pred WHERE model_id = 'm0'""",
)
def _(src):
    return P.row_folds(src.v_pred.filter("model_id = 'm0'").select("id", "label"), "label", "id", 5, 42)


@query(
    "c7_frozen_calibrator",
    f"""
WITH RECURSIVE q AS (SELECT *, {_CLIPPED} AS c FROM v_pred),
fit AS MATERIALIZED (SELECT id, model_id AS m, c AS x, label AS y FROM q WHERE id % 2 = 0 AND model_id <> 'm0'),
pt AS MATERIALIZED (SELECT model_id AS m, LN(c / (1 - c)) AS x, label AS y FROM q WHERE id % 2 = 0 AND model_id = 'm0'),
{_platt_sql("pt")}, {_isotonic_sql("fit")},
probe AS (SELECT *, model_id AS m, c AS x FROM q WHERE model_id <> 'm0'),
scored AS MATERIALIZED (SELECT q.id, q.model_id, q.label, 1 / (1 + EXP(-(a * LN(c / (1 - c)) + b))) AS p FROM q JOIN n ON n.m = q.model_id AND n.it = 15
  UNION ALL {_between_sql("probe", "r.id, r.model_id, r.label")}),
neg AS (SELECT model_id, p, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY p DESC) AS rn, COUNT(*) OVER (PARTITION BY model_id) AS n FROM scored WHERE id % 2 = 0 AND label = 0),
lim AS (SELECT DISTINCT model_id, FIRST_VALUE(p) OVER (PARTITION BY model_id ORDER BY rn) AS exceed FROM neg WHERE rn > FLOOR(50000 * n / 1000000.0))
SELECT id, model_id, label, ROUND(p, 6) AS probability, COALESCE(p > exceed, TRUE) AS called FROM scored LEFT JOIN lim USING (model_id) WHERE id % 2 = 1""",
)
def _(src):
    """Fits on one half of the rows are frozen to a folder; the other half is scored from what the folder holds."""
    fit_on, other = _half(src, True), _half(src, False).select("id", "model_id", "label", "score")
    folder = new_path(src.spark, "frozen")
    method = F.when(F.col("model_id") == "m0", "platt").otherwise("isotonic")
    chosen = fit_on.select("model_id").distinct().withColumn("method", method)
    by = ["model_id"]
    freeze_calibrators(folder, chosen, C.fit_platt(fit_on, by=by), C.fit_isotonic(fit_on, by=by))
    store = Frozen(src.spark, folder)
    known = store.calibrated(fit_on.select("model_id", "id", "label", "score"), name="score")
    freeze_thresholds(folder, R.fp_budget_threshold(known, [50000]))
    return store.called(store.calibrated(other), 50000).select("id", "model_id", "label", *r6("probability"), "called")


_CENTRES = """
WITH c AS (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS m FROM v_vec, range(1, 65) g(i) WHERE split = 'train' GROUP BY label, i),
w AS (SELECT p.i, 2 * (p.m - n.m) AS w, n.m * n.m - p.m * p.m AS b FROM c p JOIN c n ON n.i = p.i AND p.label = 1 AND n.label = 0)"""


@query(
    "c7_frozen_linear",
    f"""{_CENTRES} SELECT vec_id, ROUND(SUM(CAST(embedding[i] AS DOUBLE) * w) + (SELECT SUM(b) FROM w), 5) AS score FROM v_vec, w WHERE split = 'dev' GROUP BY vec_id""",
)
def _(src):
    """A centroid score written as weights by feature, and read back for rows in long form."""
    vec = src.v_vec
    model = N.fit_centroids(vec.filter("split = 'train'"), "embedding", "label", "euclidean")
    folder = new_path(src.spark, "frozen")
    freeze_weights(src.spark, folder, "centroid", [f"e{i}" for i in range(len(model.weights))], model.weights, model.offset)
    each = vec.filter("split = 'dev'").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    long = each.select("vec_id", F.concat(F.lit("e"), F.col("i")).alias("feature"), F.col("value").cast("double").alias("value"))
    return Frozen(src.spark, folder).linear_long(long, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


def _features(src):
    joined = src.v_site_seq.repartition("site_id")
    split = F.when(F.col("site_id") % 10 < 7, "train").otherwise("dev")
    # The label follows the sequence in part, so that a fit has something to find.
    label = F.when((F.substring("seq", 50, 1) == "T") & (F.col("site_id") % 5 < 3), 1).otherwise(F.col("label"))
    return joined.select(
        F.col("site_id").alias("id"), split.alias("split"), label.alias("label"), "seq", gc_fraction("seq").alias("gc"),
        base_count("seq", "C").cast("double").alias("c_count"), base_entropy("seq").alias("entropy"),
    )


_NUMERICS = ["gc", "c_count", "entropy"]


def _versus_random(scored, seed=42):
    """Average precision of a fitted score next to the hash-random one; scores that differ by rounding only are ties."""
    s = scored.select("id", "label", F.explode(F.array(
        F.struct(F.lit("fitted").alias("model_id"), F.round("score", 9).alias("s")),
        F.struct(F.lit("random").alias("model_id"), hash_uniform("id", seed).alias("s")),
    )).alias("e")).select("id", "label", "e.model_id", F.col("e.s").alias("score"))
    return R.area_metrics(R.score_table(cut(s))).select("model_id", "positives", "negatives", *r6("average_precision", "roc_auc"))


def _descent_sql(size: int, steps: int) -> str:
    """CTE fitted(f, w): plain gradient steps for every fit f of ``probe`` (f, c, balanced) over ``known`` (x, y), x a list of ``size`` raw features.

    Features are standardised; the steps stay below the largest curvature that correlated features of this size reach.
    """
    return f"""
moments AS MATERIALIZED (SELECT i, AVG(x[i]) AS mu, COALESCE(NULLIF(STDDEV_SAMP(x[i]), 0), 1) AS sd FROM known, range(1, {size + 1}) r(i) GROUP BY i),
centre AS MATERIALIZED (SELECT list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd FROM moments),
counted AS (SELECT COUNT(*) AS n, SUM(y) AS p FROM known),
z AS MATERIALIZED (SELECT f, c, y, CASE WHEN NOT balanced THEN 1.0 WHEN y = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END AS s, n,
  list_append(list_transform(range(1, {size + 1}), lambda i: (x[i] - mu[i]) / sd[i]), CAST(1 AS DOUBLE)) AS x FROM known, centre, counted, probe),
down(it, f, w) AS (
  SELECT 0, f, list_transform(range(0, {size + 1}), lambda i: CAST(0 AS DOUBLE)) FROM probe
  UNION ALL
  SELECT it + 1, f, list(w[i] + (g - CASE WHEN i <= {size} THEN w[i] / c ELSE 0 END) / (0.75 * n + 1 / c) ORDER BY i) FROM (
    SELECT it, f, i, ANY_VALUE(w) AS w, ANY_VALUE(c) AS c, ANY_VALUE(n) AS n, SUM(r * x[i]) AS g FROM (
      SELECT it, z.f, w, c, n, x, s * (y - 1 / (1 + EXP(-list_dot_product(x, w)))) AS r FROM down JOIN z ON z.f = down.f WHERE it < {steps}), range(1, {size + 2}) q(i)
    GROUP BY it, f, i) GROUP BY it, f),
fitted AS MATERIALIZED (SELECT f, list_transform(range(1, {size + 1}), lambda i: w[i] / sd[i]) AS v,
  w[{size + 1}] - list_dot_product(list_transform(range(1, {size + 1}), lambda i: w[i] / sd[i]), mu) AS b FROM down, centre WHERE it = {steps})"""


def _versus_random_sql(size: int, steps: int, probe: str = "(0, 1.0, FALSE)") -> str:
    """Metrics of the one fit of ``probe`` on ``known`` and of the hash, over ``asked`` (id, label, x)."""
    return f"""probe(f, c, balanced) AS (VALUES {probe}), {_descent_sql(size, steps)},
shown AS MATERIALIZED (SELECT 'fitted' AS model_id, label, ROUND(list_dot_product(x, v) + b, 9) AS score FROM asked, fitted
  UNION ALL SELECT 'random', label, CAST('0x' || substr(sha256('42|' || CAST(id AS STRING)), 1, 15) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE) FROM asked),
{_AREAS.format(pred="shown")}
SELECT a.model_id, positives, negatives, ROUND(average_precision, 6) AS average_precision, ROUND(roc_auc, 6) AS roc_auc
FROM areas a JOIN (SELECT DISTINCT model_id, positives, negatives FROM tab) USING (model_id)"""


def _count_sql(bases: str) -> str:
    return f"CAST(length(seq) - length(translate(seq, '{bases}', '')) AS DOUBLE)"


_COMPOSITION = f"""
WITH RECURSIVE rows AS MATERIALIZED (SELECT site_id AS id, site_id % 10 < 7 AS train,
    CASE WHEN substr(seq, 50, 1) = 'T' AND site_id % 5 < 3 THEN 1 ELSE label END AS label,
    [{_count_sql("GC")} / length(seq), {_count_sql("C")}, {_entropy("seq")}] AS x FROM v_site_seq),
known AS MATERIALIZED (SELECT x, label AS y FROM rows WHERE train), asked AS (SELECT id, label, x FROM rows WHERE NOT train),
"""


@query("l1_kmer_logistic")
def _(src):
    rows = cut(_features(src))
    score = N.kmer_logistic(rows.filter("split = 'train'"), "label", _NUMERICS)
    return _versus_random(score(rows.filter("split = 'dev'")).select("id", "label", "score"))


@query("l2_pairwise_kmer_ranker")
def _(src):
    rows = cut(_features(src))
    score, _ = N.all_pairs_ranker(rows.filter("split = 'train'"), "label", _NUMERICS)
    return _versus_random(score(rows.filter("split = 'dev'")).select("id", "label", "score"))


@query("l3_composition_audit", _COMPOSITION + _versus_random_sql(3, 600))
def _(src):
    rows = cut(_features(src))
    score = N.numeric_logistic(rows.filter("split = 'train'"), "label", _NUMERICS)
    return _versus_random(score(rows.filter("split = 'dev'")).select("id", "label", "score"))


@query(
    "l4_linear_probe_grid",
    f"""
WITH RECURSIVE rows AS MATERIALIZED (SELECT vec_id, label, split, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM v_vec),
known AS MATERIALIZED (SELECT x, label AS y FROM rows WHERE split = 'train'),
probe(f, c, balanced) AS (VALUES ('C0.01_weight_none', 0.01, FALSE), ('C0.01_weight_balanced', 0.01, TRUE), ('C1_weight_none', 1.0, FALSE), ('C1_weight_balanced', 1.0, TRUE)),
{_descent_sql(64, 300)},
shown AS MATERIALIZED (SELECT f AS model_id, label, ROUND(list_dot_product(x, v) + b, 9) AS score FROM rows, fitted WHERE split = 'dev'),
{_AREAS.format(pred="shown")}
SELECT model_id, ROUND(average_precision, 6) AS average_precision, ROUND(roc_auc, 6) AS roc_auc FROM areas""",
)
def _(src):
    vec = cut(src.v_vec)
    scored = N.probe_grid(vec.filter("split = 'train'"), vec.filter("split = 'dev'"), "label", "embedding", [0.01, 1.0], [False, True])
    pred = cut(scored.select(F.col("vec_id").alias("id"), "label", "model_id", F.round("score", 9).alias("score")))
    return R.area_metrics(R.score_table(pred)).select("model_id", *r6("average_precision", "roc_auc"))


_CENTROIDS = """
d AS (SELECT vec_id, label, split, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM v_vec, range(0, 64) r(i)),
c AS (SELECT i, AVG(x) FILTER (WHERE label = 1) AS p, AVG(x) FILTER (WHERE label = 0) AS n, VAR_POP(x) + 1e-4 AS v FROM d WHERE split = 'train' GROUP BY i),
norms AS (SELECT SQRT(SUM(p * p)) AS pn, SQRT(SUM(n * n)) AS nn FROM c),
s AS (SELECT vec_id, split, SUM((x - n) * (x - n)) - SUM((x - p) * (x - p)) AS euclidean, SUM((x - n) * (x - n) / v) - SUM((x - p) * (x - p) / v) AS mahalanobis,
    SUM(x * p) / (SQRT(SUM(x * x)) * MAX(pn)) - SUM(x * n) / (SQRT(SUM(x * x)) * MAX(nn)) AS cosine FROM d JOIN c ON c.i = d.i, norms GROUP BY vec_id, split),
m AS (SELECT AVG(euclidean) AS em, STDDEV_POP(euclidean) AS es, AVG(mahalanobis) AS mm, STDDEV_POP(mahalanobis) AS ms, AVG(cosine) AS cm, STDDEV_POP(cosine) AS cs FROM s WHERE split = 'train')"""


@query(
    "l5_centroid_scores",
    f"""WITH {_CENTROIDS} SELECT vec_id, ROUND(1 / (1 + EXP(-(cosine - cm) / cs)), 6) AS cosine, ROUND(1 / (1 + EXP(-(euclidean - em) / es)), 6) AS euclidean,
  ROUND(1 / (1 + EXP(-(mahalanobis - mm) / ms)), 6) AS mahalanobis FROM s, m WHERE split = 'dev'""",
)
def _(src):
    vec = src.v_vec
    train = vec.filter("split = 'train'")
    models = {m: N.fit_centroids(train, "embedding", "label", m) for m in ("cosine", "euclidean", "mahalanobis")}
    return vec.filter("split = 'dev'").select(
        "vec_id", *[F.round(model.probability("embedding"), 6).alias(m) for m, model in models.items()]
    )


@query("l6_principal_components")
def _(src):
    vec = cut(src.v_vec.select("vec_id", "label", "split", "embedding", (F.col("vec_id") % 97).cast("double").alias("depth")))
    project = N.principal_components(vec.filter("split = 'train'"), "embedding", 20)
    dev = project(vec.filter("split = 'dev'")).select("depth", F.posexplode("pc").alias("component", "value"))
    return W.correlations(dev, ["component"], "value", "depth").select("component", *r6("pearson", "spearman"))


@query(
    "l7_embedding_with_metadata",
    """
WITH RECURSIVE rows AS MATERIALIZED (SELECT vec_id AS id, label, split, list_concat(list_transform(embedding, lambda e: CAST(e AS DOUBLE)),
    [CAST(vec_id % 97 AS DOUBLE), CAST(vec_id % 13 AS DOUBLE)]) AS x FROM v_vec),
known AS MATERIALIZED (SELECT x, label AS y FROM rows WHERE split = 'train'), asked AS (SELECT id, label, x FROM rows WHERE split = 'dev'),
"""
    + _versus_random_sql(66, 600, "(0, 0.1, TRUE)"),
)
def _(src):
    vec = cut(src.v_vec.select(
        F.col("vec_id").alias("id"), "label", "split", "embedding", (F.col("vec_id") % 97).cast("double").alias("depth"),
        (F.col("vec_id") % 13).cast("double").alias("coverage"),
    ))
    score = N.numeric_logistic(vec.filter("split = 'train'"), "label", ["depth", "coverage"], c=0.1, balanced=True, array="embedding")
    return _versus_random(score(vec.filter("split = 'dev'")).select("id", "label", "score"))


_HEAD = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_SCALE = [1 + (i % 3) / 10 for i in range(64)]
_SHIFT = [(i % 5 - 2) / 100 for i in range(64)]


@query(
    "l8_layer_norm_head",
    """WITH d AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM v_vec, range(0, 64) r(i)),
m AS (SELECT vec_id, AVG(x) AS mean, VAR_POP(x) AS var FROM d GROUP BY vec_id)
SELECT d.vec_id, ROUND(1 / (1 + EXP(-(SUM((((x - mean) / SQRT(var + 1e-5)) * (1 + (i % 3) / 10.0) + (i % 5 - 2) / 100.0) * (((i * 37) % 11 - 5) / 10.0)) + 0.25))), 6) AS probability
FROM d JOIN m ON m.vec_id = d.vec_id GROUP BY d.vec_id""",
)
def _(src):
    return src.v_vec.select("vec_id", F.round(N.layer_norm_head("embedding", _SCALE, _SHIFT, _HEAD, 0.25), 6).alias("probability"))


def _scorer(batch):
    return ((batch["id"].to_numpy() * 7919) % 10007) / 10007.0


@query("l9_batch_scorer", "SELECT id, ROUND((id * 7919) % 10007 / 10007.0, 6) AS score FROM v_pool WHERE label = 0")
def _(src):
    return N.score_rows(src.v_pool.filter("label = 0").select("id"), _scorer, ["id"]).select("id", *r6("score"))


@query(
    "l10_hard_negative_round",
    """
WITH s AS (SELECT id, substr(seq, 48, 7) AS h, (id * 7919) % 10007 / 10007.0 AS score FROM v_pool WHERE label = 0 AND split = 'train' AND NOT guided),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY h ORDER BY score DESC, id) AS rn FROM s)
SELECT id, source_rank, ROUND(score, 6) AS source_score FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS source_rank FROM b WHERE rn = 1) WHERE source_rank <= 300""",
)
def _(src):
    train = src.v_pool.filter("label = 0 AND split = 'train'").select("id", F.substring("seq", 48, 7).alias("sequence_hash"))
    earlier = src.v_pool.filter("guided").select("id")
    out = N.mine_hard_negatives(train, _scorer, ["id"], 300, exclude=earlier)
    return out.select("id", "source_rank", *r6("source_score"))


_TOKENS = """
t AS (SELECT vec_id, p AS pos, list_slice(embedding, p * 8 + 1, p * 8 + 8) AS v, CASE WHEN (vec_id + p) % 4 = 0 THEN 0 ELSE 1 END AS mask FROM v_vec, range(0, 8) r(p)),
x AS (SELECT vec_id, pos, mask, i, CAST(v[i + 1] AS DOUBLE) AS x FROM t, range(0, 8) q(i))"""


@query(
    "l11_token_pooling",
    f"""WITH {_TOKENS} SELECT vec_id, i AS dim, ROUND(MAX(x) FILTER (WHERE pos = 4), 6) AS centre, ROUND(AVG(x) FILTER (WHERE pos BETWEEN 1 AND 6), 6) AS mean,
  ROUND(AVG(x) FILTER (WHERE pos BETWEEN 1 AND 6 AND mask = 1), 6) AS masked_mean, ROUND(MAX(x) FILTER (WHERE pos = 0), 6) AS cls FROM x GROUP BY vec_id, i""",
)
def _(src):
    tokens = src.v_vec.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos")).select(
        "vec_id", "pos", F.slice("embedding", F.col("pos") * 8 + 1, F.lit(8)).alias("v"),
        F.when((F.col("vec_id") + F.col("pos")) % 4 == 0, 0).otherwise(1).alias("mask"),
    )
    pooled = N.pool_tokens(tokens, "vec_id", "pos", "v", centre=4, length=6)
    names = ("centre", "mean", "masked_mean", "cls")
    zipped = F.arrays_zip(*[F.col(n).cast("array<double>").alias(n) for n in names])
    return pooled.select("vec_id", F.posexplode(zipped).alias("dim", "z")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), *[F.round(F.col(f"z.{n}"), 6).alias(n) for n in names]
    )
