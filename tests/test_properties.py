"""Property and independent-numpy checks for operators without a SQL oracle."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF0001
from kestrel.functions.stats import corr_pvalue
from kestrel.ml import series_kernels as K
from kestrel.sources.tables import Tables


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF001)


@pytest.fixture(scope="module")
def t1(spark):
    return Tables(spark, SF0001)


# ------------------------------------------------------------ kernels

def _dtw_full(x, y, w):
    n, m = len(x), len(y)
    w = max(n, m) if w <= 0 else max(w, abs(n - m))
    D = np.full((n + 1, m + 1), np.inf)
    D[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            D[i, j] = abs(x[i - 1] - y[j - 1]) + min(D[i - 1, j], D[i, j - 1], D[i - 1, j - 1])
    return D[n, m]


@pytest.mark.parametrize("w", [0, 1, 3, 10])
def test_dtw_matches_full_matrix(w):
    rng = np.random.default_rng(w)
    x, y = rng.normal(size=37), rng.normal(size=29)
    assert K.dtw(x, y, w) == pytest.approx(_dtw_full(x, y, w))
    assert K.dtw(x, x, w) == 0.0
    assert K.dtw(x, y, w) == pytest.approx(K.dtw(y, x, w))


def test_dtw_band_monotone():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=50), rng.normal(size=50)
    vals = [K.dtw(x, y, w) for w in (1, 2, 5, 10, 0)]
    assert all(a >= b - 1e-12 for a, b in zip(vals, vals[1:]))


def test_stl_sums_to_observed_and_finds_season():
    n, p = 24 * 20, 24
    t = np.arange(n)
    y = 0.01 * t + np.sin(2 * np.pi * t / p) + np.random.default_rng(0).normal(0, 0.05, n)
    T, S, R = K.stl(y, p)
    assert np.allclose(T + S + R, y)
    assert np.corrcoef(S, np.sin(2 * np.pi * t / p))[0, 1] > 0.95
    assert np.std(R) < 0.2


def test_arima_recovers_ar1_on_differences():
    rng = np.random.default_rng(3)
    dz = np.zeros(3000)
    for i in range(1, 3000):
        dz[i] = 0.5 * dz[i - 1] + rng.normal()
    y = np.cumsum(dz)
    m = K.arima_fit(y, 1, 1)
    assert m["coef"][1] == pytest.approx(0.5, abs=0.05)
    f = K.arima_forecast(y, 5, 1, 1)
    assert len(f) == 5 and np.all(np.isfinite(f))


def test_corr_pvalue_matches_t_distribution():
    # independent: numerically integrate the t density
    for r, n in [(0.3, 20), (-0.1, 50), (0.8, 8)]:
        df = n - 2
        tt = abs(r) * math.sqrt(df / (1 - r * r))
        xs = np.linspace(tt, tt + 400, 400001)
        c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
        dens = c * (1 + xs ** 2 / df) ** (-(df + 1) / 2)
        p = 2 * np.trapezoid(dens, xs)
        assert corr_pvalue(r, n) == pytest.approx(p, rel=1e-3)


# ------------------------------------------------------- spark operators

def test_pacf_equals_yule_walker_solve(spark, t):
    from kestrel.operators.timeseries import pacf
    from kestrel.plans.fixtures import hourly
    h = hourly(t)
    got = [r["pacf"] for r in pacf(h, "ts", "value", 10).orderBy("lag").collect()]
    y = np.array([r["value"] for r in h.orderBy("ts").collect()])
    n = len(y)
    x = y - y.mean()
    cov = np.array([np.sum(x[k:] * x[:n - k]) / (n - k) for k in range(11)])
    for k in range(1, 11):
        R = np.array([[cov[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(R, cov[1:k + 1])
        assert got[k] == pytest.approx(phi[-1], abs=1e-9)


def test_pca_orthogonal_and_ordered(spark, t):
    from kestrel.operators.features import fit_pca, pca
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = t.lineitem
    p = fit_pca(li, cols, 3)
    comps = np.array(p["components"])
    assert np.allclose(comps @ comps.T, np.eye(3), atol=1e-9)
    ev = p["explained_variance"]
    assert ev == sorted(ev, reverse=True)
    out = pca(li, cols, 3, params=p).toPandas()
    c = np.cov(out.to_numpy().T)
    assert abs(c[0, 1]) < 1e-6 * c[0, 0] + 1e-9
    X = li.select(*cols).toPandas().to_numpy()
    w, _ = np.linalg.eigh(np.cov(X.T))
    assert ev[0] == pytest.approx(sorted(w)[-1], rel=1e-9)


def test_train_test_split_disjoint_complete_repeatable(spark, t):
    from kestrel.ml.split import train_test_split
    o = t.orders
    tr, te = train_test_split(o, 0.2, 42, key_cols=["o_orderkey"])
    a = {r[0] for r in tr.select("o_orderkey").collect()}
    b = {r[0] for r in te.select("o_orderkey").collect()}
    assert not a & b and len(a) + len(b) == o.count() and len(b) == math.ceil(0.2 * o.count())
    tr2, te2 = train_test_split(o.repartition(17), 0.2, 42, key_cols=["o_orderkey"])
    assert {r[0] for r in te2.select("o_orderkey").collect()} == b


def test_undersample_subset_and_balanced(spark, t):
    from kestrel.operators.features import random_undersample
    d = t.documents
    u = random_undersample(d, "lang", 42, ["doc_id"])
    c = {r["lang"]: r["count"] for r in u.groupBy("lang").count().collect()}
    assert len(set(c.values())) == 1
    ids = {r[0] for r in u.select("doc_id").collect()}
    assert ids <= {r[0] for r in d.select("doc_id").collect()}
    u2 = random_undersample(d.repartition(5), "lang", 42, ["doc_id"])
    assert {r[0] for r in u2.select("doc_id").collect()} == ids


def test_smote_points_inside_class_hull_box(spark, t1):
    from kestrel.operators.features import smote
    d = t1.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("a"),
                            F.size(F.split("text", " ")).cast("double").alias("b"))
    out = smote(d, "lang", ["a", "b"], "doc_id", 5).toPandas()
    sizes = out.groupby("lang").size()
    assert sizes.nunique() == 1
    orig = d.toPandas()
    for lang, g in out[out.synthetic].groupby("lang"):
        o = orig[orig.lang == lang]
        assert g.a.between(o.a.min() - 1e-9, o.a.max() + 1e-9).all()
        assert g.b.between(o.b.min() - 1e-9, o.b.max() + 1e-9).all()


def _dbscan_brute(X, ids, eps, min_pts):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None]) ** 2).sum(-1))
    nb = D <= eps
    core = nb.sum(1) >= min_pts
    lab = -np.ones(n, dtype=np.int64)
    comp = -np.ones(n, dtype=np.int64)
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack, comp[i] = [i], i
            while stack:
                j = stack.pop()
                for k in np.where(nb[j] & core)[0]:
                    if comp[k] < 0:
                        comp[k] = i
                        stack.append(k)
    cl_min = {}
    for i in range(n):
        if core[i]:
            cl_min[comp[i]] = min(cl_min.get(comp[i], ids[i]), ids[i])
    for i in range(n):
        if core[i]:
            lab[i] = cl_min[comp[i]]
        else:
            cand = [cl_min[comp[k]] for k in np.where(nb[i] & core)[0]]
            lab[i] = min(cand) if cand else -1
    return lab


def test_dbscan_equals_brute_force(spark, t1):
    from kestrel.ml.cluster import dbscan
    from kestrel.plans.fixtures import points_2d
    p = points_2d(t1).drop("cluster")
    got = dbscan(p, "c_custkey", ["x", "y"], 1.5, 4).toPandas().sort_values("c_custkey")
    X = got[["x", "y"]].to_numpy()
    exp = _dbscan_brute(X, got.c_custkey.to_numpy(), 1.5, 4)
    assert (got.cluster.to_numpy() == exp).all()
    assert (exp >= 0).any() and (exp == -1).any()


def test_kmeans_beats_single_cluster(spark, t):
    from kestrel.ml.cluster import kmeans
    from kestrel.plans.fixtures import points_2d
    out, m = kmeans(points_2d(t).drop("cluster"), ["x", "y"], 3)
    pdf = out.toPandas()
    assert pdf.cluster.nunique() == 3
    tot = ((pdf[["x", "y"]] - pdf[["x", "y"]].mean()) ** 2).to_numpy().sum()
    within = sum(((g[["x", "y"]] - g[["x", "y"]].mean()) ** 2).to_numpy().sum() for _, g in pdf.groupby("cluster"))
    assert within < 0.6 * tot


def test_agglomerative_three_clusters(spark, t):
    from kestrel.ml.cluster import agglomerative
    from kestrel.plans.fixtures import points_2d
    out = agglomerative(points_2d(t).drop("cluster"), ["x", "y"], 3).toPandas()
    assert sorted(out.cluster.unique()) == [0, 1, 2]


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest_clf", "svc", "gradient_boosting_clf"])
def test_classifiers_learn_a_threshold(spark, kind):
    """Label value > 35 from (value, user_id): any working classifier learns it."""
    from kestrel.ml import models as M
    from kestrel.ml.split import stratified_split
    from kestrel.operators.clean import scale_standard
    e = spark.read.parquet(f"{SF0001}/events.parquet").select(
        "event_id", "value", F.col("user_id").cast("double").alias("user_id"),
        (F.col("value") > 35).cast("int").cast("string").alias("lab"))
    e = scale_standard(e, ["value", "user_id"])
    tr, te = stratified_split(e, "lab", 0.2, 42, key_cols=["event_id"])
    p = M.predict(M.fit(kind, tr, ["value", "user_id"], "lab"), te).toPandas()
    assert (p.y == p.pred).mean() > 0.85


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest_clf"])
def test_registered_classifier_queries_label_space(spark, kind):
    import __spark_entry__ as E
    p = E.queries()[kind](spark, SF001).toPandas()
    assert len(p) == 100 and set(p.pred) <= set(p.y) | {str(i) for i in range(10)}


@pytest.mark.parametrize("kind", ["linear_regression", "gradient_boosting_reg", "random_forest_reg"])
def test_regressors_fit_a_known_relation(spark, kind):
    """y = 3 value + user_id on events: any working regressor explains it."""
    from kestrel.ml import models as M
    from kestrel.ml.split import train_test_split
    e = spark.read.parquet(f"{SF0001}/events.parquet").select(
        "event_id", "value", F.col("user_id").cast("double").alias("user_id"),
        (3 * F.col("value") + F.col("user_id")).alias("y"))
    tr, te = train_test_split(e, 0.2, 42, key_cols=["event_id"])
    p = M.predict(M.fit(kind, tr, ["value", "user_id"], "y"), te).toPandas()
    r2 = 1 - ((p.y - p.pred) ** 2).sum() / ((p.y - p.y.mean()) ** 2).sum()
    assert r2 > (0.999 if kind == "linear_regression" else 0.9)


def test_cross_validate_summary(spark):
    import __spark_entry__ as E
    cv = E.queries()["cross_validate"](spark, SF001).toPandas()
    assert len(cv) == 5
    assert cv["mean"].iloc[0] == pytest.approx(cv.score.mean())
    assert cv["std"].iloc[0] == pytest.approx(cv.score.std(ddof=0))


def test_feature_importance_sums_to_one(spark):
    import __spark_entry__ as E
    fi = E.queries()["feature_importance"](spark, SF001).toPandas()
    assert fi.importance.sum() == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["arima_forecast", "trend_season_forecast", "rf_window_forecast",
                                  "direct_multi_forecast"])
def test_forecasts_have_h_finite_steps(spark, name):
    import __spark_entry__ as E
    f = E.queries()[name](spark, SF0001).toPandas()
    key = [c for c in f.columns if c not in ("step", "forecast")]
    assert np.isfinite(f.forecast).all()
    assert (f.groupby(key).size() == 10).all()


def test_auto_forecast_picks_one_best(spark):
    import __spark_entry__ as E
    f = E.queries()["auto_forecast"](spark, SF001).toPandas()
    per = f.groupby("event_type")
    assert (per.chosen.sum() == 1).all()
    best = f[f.chosen]
    assert all(len(x) == 10 for x in best.forecast)
    for _, g in per:
        assert g[g.chosen].mae.iloc[0] == g.mae.min()


def test_stl_query_sums(spark):
    import __spark_entry__ as E
    s = E.queries()["stl_decompose"](spark, SF001).toPandas()
    assert np.allclose(s.trend + s.seasonal + s.resid, s.observed)


# -------------------------------------------------------- invariances

@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partition_invariance(spark, parts):
    from kestrel.operators import profile as pr
    from kestrel.operators import resample as rs
    e = spark.read.parquet(f"{SF001}/events.parquet").repartition(parts)
    d = pr.describe_numeric(e).orderBy("column").collect()
    base = pr.describe_numeric(spark.read.parquet(f"{SF001}/events.parquet")).orderBy("column").collect()
    for a, b in zip(d, base):
        for k in ("count", "q25", "q50", "q75", "min", "max"):
            assert a[k] == b[k]
        assert a["mean"] == pytest.approx(b["mean"])
    r = rs.resample_agg(e, "ts", "1D", ("mean", "median"), "event_type").count()
    assert r == 5 * 30


# -------------------------------------------------------- edge inputs

def test_edge_frames(spark):
    from kestrel.operators import clean as cl
    from kestrel.operators import profile as pr
    empty = spark.createDataFrame([], "a double, b string")
    assert pr.shape(empty).first()["n_rows"] == 0
    assert pr.duplicate_count(empty).first()["n_duplicates"] == 0
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    d = pr.describe_numeric(one).first()
    assert d["count"] == 1 and d["std"] is None and d["q50"] == 1.0
    nulls = spark.createDataFrame([(None, "x"), (None, "y")], "a double, b string")
    assert pr.null_counts(nulls, only_missing=True).collect()[0]["n_null"] == 2
    const = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert [r.a for r in cl.scale_standard(const, ["a"]).collect()] == [0.0, 0.0]
    assert [r.a for r in cl.scale_minmax(const, ["a"]).collect()] == [0.0, 0.0]
    assert [r.a for r in cl.scale_robust(const, ["a"]).collect()] == [0.0, 0.0]


def test_nan_normalised_to_null(spark):
    from kestrel.core import nan_to_null
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "a double")
    assert nan_to_null(df).where("a IS NULL").count() == 1


def test_short_series_rolling_and_duplicate_times(spark):
    import datetime as dt
    from kestrel.operators.timeseries import rolling_mean
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i // 2), float(i)) for i in range(5)]   # repeated times
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, v double")
    out = rolling_mean(df, "ts", "v", 6, tie="id").collect()
    assert len(out) == 5 and all(r.rolling_mean is None for r in out)
    out3 = sorted(rolling_mean(df, "ts", "v", 3, tie="id").collect(), key=lambda r: r.id)
    assert [r.rolling_mean for r in out3] == [None, None, 1.0, 2.0, 3.0]


def test_dst_day_is_one_daily_bin(spark):
    import datetime as dt
    from kestrel.operators.resample import resample_agg
    # 2024-03-31 in Europe/Madrid has 23 hours: 22:00 UTC on 03-30 .. 21:59 UTC on 03-31
    rows = [(t, 1.0) for t in (dt.datetime(2024, 3, 30, 23, 30), dt.datetime(2024, 3, 31, 21, 30))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = resample_agg(df, "ts", "D", ("mean",), timezone="Europe/Madrid").collect()
    assert len(out) == 1 and out[0]["ts"] == dt.datetime(2024, 3, 31)


def test_one_class_only_undersample(spark):
    from kestrel.operators.features import random_undersample
    df = spark.createDataFrame([(i, "a") for i in range(10)], "id long, c string")
    assert random_undersample(df, "c", key_cols=["id"]).count() == 10


def test_time_index_all_bad_raises(spark):
    from kestrel.core import TimeConfig
    from kestrel.functions.scalar import check_time_index, time_index
    df = spark.createDataFrame([("bad",), ("worse",)], "t string")
    _, st = time_index(df, TimeConfig("t"))
    with pytest.raises(ValueError):
        check_time_index(st)


def test_threshold_label_name_collision(spark):
    from kestrel.functions.scalar import threshold_label
    df = spark.createDataFrame([(1.0, 0)], "x double, etiqueta_binaria int")
    assert "etiqueta_binaria_2" in threshold_label(df, "x", ">", 0).columns


def test_select_kbest_keeps_k_plus_target(spark, t):
    from kestrel.operators.features import select_kbest
    out = select_kbest(t.lineitem, "l_returnflag", 3)
    assert len(out.columns) == 4 and out.columns[-1] == "l_returnflag"


# -------------------------------------------------------------- sources

def test_read_json_column_oriented(spark, tmp_path):
    pdf = pd.DataFrame({"a": [1.5, 2.0, None], "b": ["x", "y", "z"]})
    p = tmp_path / "t.json"
    pdf.to_json(p)            # {"a": {"0": 1.5, ...}, "b": {...}}
    from kestrel.sources.files import read_json
    out = read_json(spark, str(p), orient="columns").toPandas()
    assert list(out.columns) == ["a", "b"]
    assert out.a.tolist()[:2] == [1.5, 2.0] and math.isnan(out.a.tolist()[2]) and out.b.tolist() == ["x", "y", "z"]


def test_read_source_rejects_unknown_and_empty(spark, tmp_path):
    from kestrel.sources.files import read_source
    (tmp_path / "x.txt").write_text("a\n1\n")
    with pytest.raises(ValueError):
        read_source(spark, str(tmp_path / "x.txt"))
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        read_source(spark, str(tmp_path / "e.csv"))


def test_jdbc_listing_sql_escapes_schema():
    from kestrel.sources.jdbc import list_tables_sql, table_ref
    q = list_tables_sql("o'brien")
    assert "'o''brien'" in q and "BASE TABLE" in q
    assert "SYS.SYSTABLES" in list_tables_sql(None, "derby")
    assert table_ref('we"ird', "t") == '"we""ird"."t"'


def test_model_save_load_roundtrip(spark):
    import __spark_entry__ as E
    p = E.queries()["save_model"](spark, SF0001).toPandas()
    assert len(p) > 0 and p.pred.notna().all()
