"""Registered queries (see registry.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, rounded
from .fixtures import tables
from ..ml import cluster as cl
from ..ml import evaluate as ev
from ..ml import models as M
from ..ml import split as sp
from ..ml.neighbors import knn_classify
from ..operators import metrics as mt
from . import fixtures as fx
from .fixtures import with_ctes

_EMB_DIMS = 64         # all embedding coordinates, as tabular features


def _emb(spark, sf_dir, dims=_EMB_DIMS):
    e = tables(spark, sf_dir).embeddings
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)],
                    F.col("label").cast("string").alias("label"))


_EMB_COLS = [f"e{i}" for i in range(_EMB_DIMS)]
_LI_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


_DRAW = "substr(md5('42|' || CAST({key} AS VARCHAR)), 1, 13)"


@query("train_test_split", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_DRAW.format(key="o_orderkey")}, o_orderkey)
                             <= (SELECT ceil(0.2 * count(*)) FROM orders) THEN 'test' ELSE 'train' END AS part
FROM orders""")
def q_train_test_split(spark, sf_dir):
    """Part of every order in a seeded 80/20 split (ceil rule for the test part)."""
    tr, te = sp.train_test_split(tables(spark, sf_dir).orders.select("o_orderkey"), 0.2, 42, key_cols=["o_orderkey"])
    return (tr.select("o_orderkey", F.lit("train").alias("part"))
            .unionByName(te.select("o_orderkey", F.lit("test").alias("part"))))


@query("stratified_split", f"""
WITH c AS (SELECT lang, count(*) AS n, 0.2 * count(*) AS e, floor(0.2 * count(*)) AS f FROM documents GROUP BY 1),
t AS (SELECT (SELECT ceil(0.2 * sum(n)) FROM c) - sum(f) AS rest FROM c),
k AS (SELECT lang, f + CASE WHEN row_number() OVER (ORDER BY e - f DESC, lang) <= (SELECT rest FROM t) THEN 1 ELSE 0 END AS k
      FROM c)
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(key="doc_id")}, doc_id) <= k.k
                          THEN 'test' ELSE 'train' END AS part
FROM documents JOIN k USING (lang)""")
def q_stratified_split(spark, sf_dir):
    """Part of every document in an 80/20 split stratified by language."""
    tr, te = sp.stratified_split(tables(spark, sf_dir).documents.select("doc_id", "lang"), "lang", 0.2, 42, key_cols=["doc_id"])
    return (tr.select("doc_id", "lang", F.lit("train").alias("part"))
            .unionByName(te.select("doc_id", "lang", F.lit("test").alias("part"))))


def _clf_query(kind):
    def run(spark, sf_dir):
        tr, te = sp.stratified_split(_emb(spark, sf_dir), "label", 0.2, 42, key_cols=["vec_id"])
        m = M.fit(kind, tr, _EMB_COLS, "label")
        return M.predict(m, te, keep=["vec_id"]).select("vec_id", "y", "pred")
    run.__doc__ = f"{kind} on the 64 embedding coordinates -> label; predictions on a stratified 20% test split."
    return run


def _quality(spark, sf_dir):
    """Binary task from the tables: document quality from length features."""
    t = tables(spark, sf_dir)
    d = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                           F.size(F.split("text", " ")).cast("double").alias("n_words"),
                           F.size(F.split("text", "\n")).cast("double").alias("n_lines"))
    return d.join(t.labels.select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")


def _binary_clf_query(kind):
    def run(spark, sf_dir):
        tr, te = sp.stratified_split(_quality(spark, sf_dir), "quality", 0.2, 42, key_cols=["doc_id"])
        m = M.fit(kind, tr, ["n_chars", "n_words", "n_lines"], "quality")
        return M.predict(m, te, keep=["doc_id"]).select("doc_id", "y", "pred")
    run.__doc__ = f"{kind} (binary): document quality from length features; stratified 20% test split."
    return run


for _k in ("logistic_regression", "random_forest_clf", "svc"):
    query(_k)(_clf_query(_k))
for _k in ("gradient_boosting_clf", "xgb_clf", "lgbm_clf"):
    query(_k)(_binary_clf_query(_k))


def _reg_query(kind):
    def run(spark, sf_dir):
        li = tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", *_LI_FEATS[:-1], "l_extendedprice")
        tr, te = sp.train_test_split(li, 0.2, 42, key_cols=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
        m = M.fit(kind, tr, _LI_FEATS, "l_extendedprice")
        return M.predict(m, te, keep=["l_orderkey", "l_linenumber"])
    run.__doc__ = f"{kind}: lineitem extended price from quantity, discount, tax, line number; 20% test split."
    return run


for _k in M.REGRESSORS:
    query(_k)(_reg_query(_k))


@query("linear_regression_1d", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_linreg_1d(spark, sf_dir):
    """OLS of extended price on quantity over all of lineitem (coefficients)."""
    m = M.fit("linear_regression", tables(spark, sf_dir).lineitem, ["l_quantity"], "l_extendedprice")
    lr = m.pipeline.stages[0]
    return spark.createDataFrame([(round(float(lr.coefficients[0]), 4), round(float(lr.intercept), 4))],
                                 "slope double, intercept double")


@query("svr")
def q_svr(spark, sf_dir):
    """RBF-approximating epsilon-insensitive regression of the standardised hourly mean on its 3 lags."""
    from ..operators.clean import scale_standard
    from ..operators.timeseries import lag_features
    lf = lag_features(fx.hourly(tables(spark, sf_dir)), "ts", "value", 3, 0)
    lf = scale_standard(lf, ["lag_1", "lag_2", "lag_3", "y"])
    p = M.fit_svr(lf, ["lag_1", "lag_2", "lag_3"], "y")
    return M.predict_svr(p, lf, "y", keep=["ts"])


@query("knn_classifier", """
WITH p AS (SELECT c_custkey, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment AS seg FROM customer),
d AS (SELECT q.c_custkey, r.seg, row_number() OVER (PARTITION BY q.c_custkey
        ORDER BY sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)), r.c_custkey) AS rk
      FROM p q JOIN p r ON q.c_custkey <> r.c_custkey),
v AS (SELECT c_custkey, seg, count(*) AS votes FROM d WHERE rk <= 5 GROUP BY 1, 2),
b AS (SELECT c_custkey, seg, row_number() OVER (PARTITION BY c_custkey ORDER BY votes DESC, seg) AS rk FROM v)
SELECT c_custkey, seg AS pred FROM b WHERE rk = 1""")
def q_knn(spark, sf_dir):
    """Leave-one-out 5-NN vote of market segment from (balance, nation) for
    every customer. The oracle is brute force over all pairs of the fixture."""
    p = fx.points_2d(tables(spark, sf_dir)).withColumnRenamed("cluster", "seg")
    out = knn_classify(p, p, "c_custkey", ["x", "y"], "seg", 5, exclude_self=True)
    return out.select("c_custkey", "pred")


_WIDE_DISTANCE = "sqrt(list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


@query("knn_classifier_wide", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS label FROM embeddings),
d AS (SELECT q.vec_id, q.label AS own, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_WIDE_DISTANCE}, r.vec_id) AS rk
      FROM e q JOIN e r ON q.vec_id <> r.vec_id),
v AS (SELECT vec_id, own, label, count(*) AS votes FROM d WHERE rk <= 5 GROUP BY ALL),
b AS (SELECT vec_id, own, label, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS rk FROM v)
SELECT vec_id, own AS label, label AS pred FROM b WHERE rk = 1""")
def q_knn_wide(spark, sf_dir):
    """Leave-one-out 5-NN vote of the label from all 64 embedding coordinates, exact (cells around pivots)."""
    e = _emb(spark, sf_dir)
    return knn_classify(e, e, "vec_id", _EMB_COLS, "label", 5, exclude_self=True).select("vec_id", "label", "pred")


@query("cross_validate")
def q_cross_validate(spark, sf_dir):
    """5-fold stratified CV of logistic regression on the 64 embedding coordinates."""
    return ev.cross_validate("logistic_regression", _emb(spark, sf_dir), _EMB_COLS, "label", 5,
                             key_cols=["vec_id"])


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Random forest importances of the lineitem price model's features."""
    li = tables(spark, sf_dir).lineitem
    m = M.fit("random_forest_reg", li, _LI_FEATS, "l_extendedprice")
    return M.feature_importance(m)


@query("kmeans")
def q_kmeans(spark, sf_dir):
    """k-means (k = 3) of the customer points."""
    out, _ = cl.kmeans(fx.points_2d(tables(spark, sf_dir)).drop("cluster"), ["x", "y"], 3)
    return out.select("c_custkey", "x", "y", "cluster")


@query("dbscan", with_ctes(fx.POINTS_2D).rstrip().replace("WITH", "WITH RECURSIVE", 1) + """,
e AS (SELECT a.c_custkey AS i, b.c_custkey AS j FROM points_2d a JOIN points_2d b
      ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25),
core AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 5),
ce AS (SELECT e.i, e.j FROM e JOIN core a ON e.i = a.i JOIN core b ON e.j = b.i),
r(i, root) AS (SELECT i, i FROM core UNION SELECT ce.j, r.root FROM r JOIN ce ON ce.i = r.i),
lab AS (SELECT i, min(root) AS label FROM r GROUP BY i),
b AS (SELECT e.i, min(lab.label) AS label FROM e JOIN lab ON e.j = lab.i GROUP BY e.i)
SELECT c_custkey, x, y, CAST(coalesce(lab.label, b.label, -1) AS BIGINT) AS cluster
FROM points_2d LEFT JOIN lab ON lab.i = c_custkey LEFT JOIN b ON b.i = c_custkey""")
def q_dbscan(spark, sf_dir):
    """DBSCAN (eps 0.5, 5 points) of the customer points."""
    return cl.dbscan(fx.points_2d(tables(spark, sf_dir)).drop("cluster"), "c_custkey", ["x", "y"], 0.5, 5) \
             .select("c_custkey", "x", "y", "cluster")


_WIDE_COLS = [f"e{i}" for i in range(16)]


@query("dbscan_wide", """
WITH RECURSIVE p AS (SELECT vec_id AS i, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT q.i, r.i AS j FROM p q JOIN p r
      ON list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) <= 0.47 * 0.47),
core AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 5),
ce AS (SELECT e.i, e.j FROM e JOIN core a ON e.i = a.i JOIN core b ON e.j = b.i),
r(i, root) AS (SELECT i, i FROM core UNION SELECT ce.j, r.root FROM r JOIN ce ON ce.i = r.i),
lab AS (SELECT i, min(root) AS label FROM r GROUP BY i),
b AS (SELECT e.i, min(lab.label) AS label FROM e JOIN lab ON e.j = lab.i GROUP BY e.i)
SELECT p.i AS vec_id, CAST(coalesce(lab.label, b.label, -1) AS BIGINT) AS cluster
FROM p LEFT JOIN lab ON lab.i = p.i LEFT JOIN b ON b.i = p.i""")
def q_dbscan_wide(spark, sf_dir):
    """DBSCAN (eps 0.47, 5 points) on 16 embedding coordinates."""
    return cl.dbscan(_emb(spark, sf_dir, 16), "vec_id", _WIDE_COLS, 0.47, 5).select("vec_id", "cluster")


@query("agglomerative")
def q_agglomerative(spark, sf_dir):
    """Exact Ward clustering (3 clusters) of the customer points."""
    return cl.agglomerative(fx.points_2d(tables(spark, sf_dir)).drop("cluster"), ["x", "y"], 3)


@query("sequence_classifier")
def q_sequence_classifier(spark, sf_dir):
    """MLP on 14-hour windows of (mean, count) -> hourly mean above 35: accuracy, precision,
    recall, F1 and AUC on a stratified 20 % test split; windows are scaled by the training part."""
    from ..functions.scalar import threshold_label
    from ..operators.timeseries import sequence_windows
    h = threshold_label(fx.hourly(tables(spark, sf_dir)), "value", ">", 35, name="lab")
    seq = sequence_windows(h, "ts", ["value", "n"], "lab", 14).select("ts", "seq", "label")
    tr, te = sp.stratified_split(seq, "label", 0.2, 42, key_cols=["ts"])
    flat = F.flatten("seq")
    part = lambda k: F.filter(flat, lambda x, i: i % 2 == k)
    r = tr.agg(*[f(g(part(k))).alias(f"{n}{k}") for k in (0, 1)
                 for n, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))]).first()
    scale = lambda x, k: (x - r[f"lo{k}"]) / ((r[f"hi{k}"] - r[f"lo{k}"]) or 1.0)
    scaled = F.transform("seq", lambda x: F.array(scale(x[0], 0), scale(x[1], 1)))
    m = M.fit_sequence_classifier(tr.withColumn("seq", scaled), 14, 2)
    p = M.predict_sequence_classifier(m, te.withColumn("seq", scaled))
    yes, hit = (F.col("y") == "1"), (F.col("pred") == "1")
    c = p.agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"), F.count_if(yes & hit).alias("tp"),
              F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"))
    auc = mt.roc_auc(p.select(yes.cast("int").alias("y"), "score")).first()[0]
    # 0 when undefined, as in metrics.prf_binary; an AUC of one class only is NULL
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("accuracy", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                    F.lit(auc).cast("double").alias("auc"))


# ------------------------------------------------------------- forecasting
from ..ml import forecast as fc  # noqa: E402


def _hourly_by_type(spark, sf_dir):
    """Regular hourly mean series per event type (gaps interpolated)."""
    return fc.regular_series(tables(spark, sf_dir).events, "ts", "value", "1H", ["event_type"])


def _hourly_one(spark, sf_dir):
    return fc.regular_series(tables(spark, sf_dir).events, "ts", "value", "1H")


@query("stl_decompose")
def q_stl(spark, sf_dir):
    """STL (period 24) of the hourly mean series of every event type."""
    return fc.stl_decompose(_hourly_by_type(spark, sf_dir), "ts", "value", ["event_type"], 24)


@query("dtw_distance")
def q_dtw(spark, sf_dir):
    """DTW (band 24) between the hourly series of every pair of event types."""
    return fc.dtw_distance(_hourly_by_type(spark, sf_dir), "ts", "value", "event_type", window=24)


def _arima_sql(cte: str, src: str, key: str) -> str:
    """ARIMA(1, 1, 0) over series of ``src`` (key, ts, value) by regr_slope on differences."""
    return f"""WITH RECURSIVE {cte},
s AS (SELECT {key} AS k, value AS y, row_number() OVER (PARTITION BY {key} ORDER BY ts) - 1 AS pos FROM {src} WHERE value IS NOT NULL),
z AS (SELECT k, pos, y, y - lag(y) OVER (PARTITION BY k ORDER BY pos) AS z FROM s),
l AS (SELECT *, lag(z) OVER (PARTITION BY k ORDER BY pos) AS x FROM z),
c AS (SELECT k, coalesce(CASE WHEN var_pop(x) > 0 THEN covar_pop(x, z) / var_pop(x) END, 0) AS phi, avg(x) AS mx, avg(z) AS mz
      FROM l WHERE pos >= 2 GROUP BY k),
n AS (SELECT k, count(*) AS n, arg_max(y, pos) AS y, arg_max(z, pos) AS z FROM l GROUP BY k),
f(k, step, i, y, z, phi, a) AS (
  SELECT n.k, n.n, 0, n.y + (mz - phi * mx + phi * n.z), mz - phi * mx + phi * n.z, phi, mz - phi * mx FROM n LEFT JOIN c USING (k)
  UNION ALL SELECT k, step + 1, i + 1, y + a + phi * z, a + phi * z, phi, a FROM f WHERE i < 9)
"""


@query("arima_forecast", _arima_sql(fx.USER_DAILY, "user_daily", "user_id")
       + "SELECT k AS user_id, step, round(y, 4) AS forecast FROM f")
def q_arima(spark, sf_dir):
    """ARIMA(1,1,0), 10 steps, for the daily value sum of every user."""
    return rounded(fc.arima_forecast(fx.user_daily(tables(spark, sf_dir)), "ts", "value", ["user_id"], 10), 4)


@query("trend_season_forecast")
def q_trend_season(spark, sf_dir):
    """Trend + daily seasonality (ridge), 10 hours ahead, per event type."""
    return fc.trend_season_forecast(_hourly_by_type(spark, sf_dir), "ts", "value", ["event_type"], 10, 24)


@query("rf_window_forecast")
def q_rf_window(spark, sf_dir):
    """Global random forest on 5 lags, 10 recursive steps, per event type."""
    return fc.window_forecast(_hourly_by_type(spark, sf_dir), "ts", "value", ["event_type"], "rf", 5, 10)


@query("gbt_window_forecast")
def q_gbt_window(spark, sf_dir):
    """Global boosted trees on 5 lags, 10 recursive steps, per event type."""
    return fc.window_forecast(_hourly_by_type(spark, sf_dir), "ts", "value", ["event_type"], "gbt", 5, 10)


@query("direct_multi_forecast")
def q_direct_multi(spark, sf_dir):
    """Scaled 10-value windows -> 10 values ahead (10 linear models), per event type."""
    return fc.direct_multi_forecast(_hourly_by_type(spark, sf_dir), "ts", "value", ["event_type"], 10, 10)


@query("auto_forecast")
def q_auto_forecast(spark, sf_dir):
    """ARIMA / smoothing / theta scored on the last 10 hours, best refitted, per event type."""
    return fc.auto_forecast(_hourly_by_type(spark, sf_dir), "ts", "value", ["event_type"], 10)


@query("auto_forecast_search")
def q_auto_search(spark, sf_dir):
    """Candidate search (level 'medio', 2 rolling validations, 90 % interval) per event type."""
    return fc.auto_forecast_search(_hourly_by_type(spark, sf_dir), "ts", "value", ["event_type"], 10, "medio")


@query("forecast_table", _arima_sql(fx.USER_DAILY, "user_daily", "user_id") + """
SELECT k AS user_id, step, round(y, 4) AS value, 'forecast' AS kind FROM f
UNION ALL SELECT k, pos, round(y, 4), 'history' FROM s""")
def q_forecast_table(spark, sf_dir):
    """History and ARIMA forecast rows of the daily value sum of every user."""
    s = fx.user_daily(tables(spark, sf_dir))
    f = fc.arima_forecast(s, "ts", "value", ["user_id"], 10)
    return rounded(fc.forecast_table(s, f, "ts", "value", ["user_id"]), 4)
