"""Registered queries (see registry.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, rounded
from .fixtures import tables
from ..operators import metrics as mt
from . import fixtures as fx
from .fixtures import with_ctes

_B = with_ctes(fx.PRED_BINARY)
_R = with_ctes(fx.PRED_REG)
_M = with_ctes(fx.PRED_MULTI)
_P = with_ctes(fx.POINTS_2D)


def _t(spark, sf_dir):
    return tables(spark, sf_dir)


@query("accuracy", _M + "SELECT round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy FROM pred_multi")
def q_accuracy(spark, sf_dir):
    """Share of equal labels (three return flags, every 5th order shifted)."""
    return rounded(mt.accuracy(fx.pred_multi(_t(spark, sf_dir))))


_CLASS_SQL = """, pairs AS (SELECT y, pred, count(*) AS n FROM pred_multi GROUP BY 1, 2),
labs AS (SELECT y AS c FROM pairs UNION SELECT pred FROM pairs),
cc AS (SELECT c,
  coalesce((SELECT sum(n) FROM pairs WHERE y = c), 0) AS support,
  coalesce((SELECT sum(n) FROM pairs WHERE pred = c), 0) AS predicted,
  coalesce((SELECT sum(n) FROM pairs WHERE y = c AND pred = c), 0) AS tp FROM labs),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
                CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM cc)
"""


@query("prf_weighted", _M + _CLASS_SQL + """
SELECT round(sum(p * support) / sum(support), 6) AS precision_weighted,
       round(sum(r * support) / sum(support), 6) AS recall_weighted,
       round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1_weighted
FROM m""")
def q_prf_weighted(spark, sf_dir):
    """Support-weighted precision, recall and F1 of the shifted flags."""
    return rounded(mt.prf_weighted(fx.pred_multi(_t(spark, sf_dir))))


@query("prf_binary", _B + """, c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
  count(*) FILTER (WHERE pred = 1) AS predicted, count(*) FILTER (WHERE y = 1) AS support FROM pred_binary),
m AS (SELECT CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM c)
SELECT round(p, 6) AS precision_binary, round(r, 6) AS recall_binary,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_binary FROM m""")
def q_prf_binary(spark, sf_dir):
    """Precision, recall, F1 of class 1 for y = value > 35, pred = value > 40."""
    return rounded(mt.prf_binary(fx.pred_binary(_t(spark, sf_dir))))


_AUC_SQL = """, rk AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
  FROM pred_binary)
SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS roc_auc FROM rk"""


@query("roc_auc", _B + _AUC_SQL)
def q_roc_auc(spark, sf_dir):
    """Exact ROC AUC of score = value / 500 for y = value > 35."""
    return rounded(mt.roc_auc(fx.pred_binary(_t(spark, sf_dir))))


@query("roc_auc_ovr", _M + """, l AS (
  SELECT 'A' AS cls, y = 'A' AS pos, score_A AS s FROM pred_multi UNION ALL
  SELECT 'N', y = 'N', score_N FROM pred_multi UNION ALL
  SELECT 'R', y = 'R', score_R FROM pred_multi),
rk AS (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY s)
       + (count(*) OVER (PARTITION BY cls, s) - 1) / 2.0 AS r FROM l),
a AS (SELECT cls, (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)
  / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)) AS auc FROM rk GROUP BY cls)
SELECT round(avg(auc), 6) AS roc_auc_ovr FROM a""")
def q_roc_auc_ovr(spark, sf_dir):
    """One-vs-rest macro AUC of three class scores."""
    return rounded(mt.roc_auc_ovr(fx.pred_multi(_t(spark, sf_dir)), "y",
                                  {"A": "score_A", "N": "score_N", "R": "score_R"}))


@query("confusion_matrix", _M + """
SELECT y AS actual, count(*) FILTER (WHERE pred = 'A') AS pred_A, count(*) FILTER (WHERE pred = 'N') AS pred_N,
       count(*) FILTER (WHERE pred = 'R') AS pred_R FROM pred_multi GROUP BY y""")
def q_confusion(spark, sf_dir):
    """Actual x predicted counts of the shifted flags."""
    return mt.confusion_matrix(fx.pred_multi(_t(spark, sf_dir)))


@query("regression_metrics", _R + """
SELECT round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2,
       round(avg(abs(y - pred)), 6) AS mae, round(avg((y - pred) * (y - pred)), 4) AS mse,
       round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse FROM pred_reg""")
def q_regression_metrics(spark, sf_dir):
    """r2, mae, mse, rmse of a prediction off by (linenumber - 3) %."""
    r = mt.regression_metrics(fx.pred_reg(_t(spark, sf_dir)))
    return r.select(F.round("r2", 6).alias("r2"), F.round("mae", 6).alias("mae"),
                    F.round("mse", 4).alias("mse"), F.round("rmse", 6).alias("rmse"))


@query("mape", _R + "SELECT round(avg(abs((y - pred) / y)), 6) AS mape FROM pred_reg WHERE y <> 0")
def q_mape(spark, sf_dir):
    """Mean absolute percentage error (y = 0 excluded)."""
    return rounded(mt.mape(fx.pred_reg(_t(spark, sf_dir))))


@query("silhouette", _P + """, d AS (
  SELECT a.c_custkey, a.cluster AS ca, b.cluster AS cb,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2
  FROM points_2d a JOIN points_2d b ON a.c_custkey <> b.c_custkey),
m AS (SELECT c_custkey, ca, cb, sum(d2) AS s, count(*) AS k FROM d GROUP BY 1, 2, 3),
ab AS (SELECT c_custkey,
  max(CASE WHEN ca = cb THEN s / k END) AS a, min(CASE WHEN ca <> cb THEN s / (k) END) AS b FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def q_silhouette(spark, sf_dir):
    """Silhouette (Euclidean) of customers clustered by market segment; the oracle is brute force over all pairs."""
    return rounded(mt.silhouette(fx.points_2d(_t(spark, sf_dir)), ["x", "y"], "cluster"))


@query("davies_bouldin", _P + """, c AS (SELECT cluster, avg(x) AS mx, avg(y) AS my FROM points_2d GROUP BY 1),
s AS (SELECT p.cluster, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS s FROM points_2d p JOIN c USING (cluster) GROUP BY 1),
cs AS (SELECT * FROM c JOIN s USING (cluster)),
r AS (SELECT a.cluster, max((a.s + b.s) / sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my))) AS r
      FROM cs a JOIN cs b ON a.cluster <> b.cluster GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def q_davies_bouldin(spark, sf_dir):
    """Davies-Bouldin index of customers by market segment."""
    return rounded(mt.davies_bouldin(fx.points_2d(_t(spark, sf_dir)), ["x", "y"], "cluster"))


@query("calinski_harabasz", _P + """, g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM points_2d),
c AS (SELECT cluster, avg(x) AS mx, avg(y) AS my, count(*) AS nc FROM points_2d GROUP BY 1),
w AS (SELECT sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS w FROM points_2d JOIN c USING (cluster)),
b AS (SELECT sum(nc * ((mx - gx) * (mx - gx) + (my - gy) * (my - gy))) AS b, count(*) AS k FROM c, g)
SELECT round((b / (k - 1)) / (w / ((SELECT n FROM g) - k)), 6) AS calinski_harabasz FROM b, w""")
def q_calinski(spark, sf_dir):
    """Calinski-Harabasz index of customers by market segment."""
    return rounded(mt.calinski_harabasz(fx.points_2d(_t(spark, sf_dir)), ["x", "y"], "cluster"))


@query("actual_vs_predicted", _R + "SELECT round(y, 6) AS actual, round(pred, 6) AS predicted FROM pred_reg")
def q_actual_vs_predicted(spark, sf_dir):
    """(actual, predicted) table of the regression fixture."""
    return rounded(mt.actual_vs_predicted(fx.pred_reg(_t(spark, sf_dir))))
