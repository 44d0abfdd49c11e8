"""Registered queries (see registry.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, rounded
from .fixtures import tables
from ..operators import features as ft
from . import fixtures as fx
from .fixtures import with_ctes

_KB_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]

_KB_SQL = "WITH " + ",\n".join(
    [f"""s_{c} AS (SELECT '{c}' AS feature, l_returnflag, count(*) AS n, avg({c}::DOUBLE) AS m,
        var_pop({c}::DOUBLE) AS v FROM lineitem GROUP BY l_returnflag)""" for c in _KB_COLS]) + """,
per AS (""" + " UNION ALL ".join(f"SELECT * FROM s_{c}" for c in _KB_COLS) + """),
g AS (SELECT feature, sum(n * m) / sum(n) AS gm, sum(n) AS nt, count(*) AS k FROM per GROUP BY 1),
f AS (SELECT feature, CASE WHEN sum(n * v) > 0 THEN (sum(n * (m - gm) * (m - gm)) / (any_value(k) - 1))
           / (sum(n * v) / (any_value(nt) - any_value(k))) END AS f_score
      FROM per JOIN g USING (feature) GROUP BY feature)
SELECT feature, round(f_score, 4) AS f_score,
       CAST(row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) <= 3 AS selected FROM f"""


@query("select_kbest", _KB_SQL)
def q_select_kbest(spark, sf_dir):
    """ANOVA F of lineitem numeric columns against the return flag; best 3 selected."""
    out = ft.kbest_scores(tables(spark, sf_dir).lineitem, "l_returnflag", 3, _KB_COLS)
    return out.select("feature", F.round("f_score", 4).alias("f_score"), F.col("rank").cast("int").alias("rank"),
                      "selected")


@query("variance_threshold", with_ctes(fx.LINEITEM_CONST) +
       "SELECT " + ", ".join(_KB_COLS) + " FROM lineitem_const")
def q_variance_threshold(spark, sf_dir):
    """lineitem plus a constant column: numeric columns with variance > 0 kept."""
    return ft.variance_threshold(fx.lineitem_const(tables(spark, sf_dir)))


@query("random_undersample", """
WITH m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM documents GROUP BY lang)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
             ORDER BY substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 13), doc_id) AS k FROM documents)
SELECT doc_id, lang FROM r WHERE k <= (SELECT n FROM m)""")
def q_random_undersample(spark, sf_dir):
    """Documents undersampled by language: every language cut to the smallest."""
    d = ft.random_undersample(tables(spark, sf_dir).documents.select("doc_id", "lang"), "lang", seed=42, key_cols=["doc_id"])
    return d.select("doc_id", "lang")


@query("pca")
def q_pca(spark, sf_dir):
    """Centred PCA of all numeric columns of lineitem, standardised -> PCA_1, PCA_2 (property-checked)."""
    from ..core import numeric_columns
    from ..operators.clean import scale_standard
    li = tables(spark, sf_dir).lineitem
    cols = numeric_columns(li)
    return ft.pca(scale_standard(li, cols), cols, 2)


@query("pca_projection", fx.with_ctes(fx.POINTS_2D).rstrip() + """,
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM points_2d),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1 FROM m),
v AS (SELECT *, CASE WHEN b <> 0 THEN b ELSE CASE WHEN a >= c THEN 1 ELSE 0 END END AS u0,
             CASE WHEN b <> 0 THEN l1 - a ELSE CASE WHEN a >= c THEN 0 ELSE 1 END END AS w0 FROM e),
n AS (SELECT *, u0 / sqrt(u0 * u0 + w0 * w0) AS u1, w0 / sqrt(u0 * u0 + w0 * w0) AS w1 FROM v),
g AS (SELECT *, CASE WHEN CASE WHEN abs(u1) >= abs(w1) THEN u1 ELSE w1 END < 0 THEN -1 ELSE 1 END AS s1,
             CASE WHEN CASE WHEN abs(w1) >= abs(u1) THEN -w1 ELSE u1 END < 0 THEN -1 ELSE 1 END AS s2 FROM n)
SELECT cluster, round(s1 * ((x - mx) * u1 + (y - my) * w1), 4) AS PCA_1,
       round(s2 * ((x - mx) * -w1 + (y - my) * u1), 4) AS PCA_2
FROM points_2d, g""")
def q_pca_projection(spark, sf_dir):
    """Two components of the 2-d customer points with their segment."""
    return rounded(ft.pca_projection(fx.points_2d(tables(spark, sf_dir)), ["x", "y"], "cluster"), 4)


def _doc_feats(spark, sf_dir):
    d = tables(spark, sf_dir).documents
    return d.select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(F.split("text", " ")).cast("double").alias("n_words"))


@query("smote", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, (SELECT max(n) FROM c) AS n FROM c""")
def q_smote(spark, sf_dir):
    """Documents balanced by language with SMOTE on (chars, words): class sizes."""
    out = ft.smote(_doc_feats(spark, sf_dir), "lang", ["n_chars", "n_words"], "doc_id", 5)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
