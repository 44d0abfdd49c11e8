"""No row is lost or doubled where inputs hold NULLs, repeats and odd shapes."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.ml import cluster as cl
from kestrel.ml import forecast as fc
from kestrel.ml import models as M
from kestrel.ml import split as sp
from kestrel.operators import features as ft
from kestrel.operators import resample as rs
from kestrel.operators.components import components


def _count(parts):
    return [p.count() for p in parts]


def test_splits_of_repeated_rows_and_null_keys(spark):
    same = spark.createDataFrame([(1, "a")] * 10, "k int, g string")
    assert _count(sp.train_test_split(same, 0.2)) == [8, 2]
    rows = [(None if k % 4 == 0 else k, "abc"[k % 3] if k % 7 else None, k) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, g string, id int")
    for tr, te in (sp.train_test_split(df, 0.2, key_cols=["k"]), sp.stratified_split(df, "g", 0.2, key_cols=["k"])):
        a, b = ([r.id for r in p.collect()] for p in (tr, te))
        assert len(b) == 12 and sorted(a + b) == list(range(60))
    small = ft.random_undersample(df, "g", key_cols=["k"])
    sizes = {r.g: r["count"] for r in small.groupBy("g").count().collect()}
    assert set(sizes) == {"a", "b", "c"} and len(set(sizes.values())) == 1


def test_scoring_keeps_rows_with_missing_features(spark):
    rng = random.Random(1)
    rows = [(k, float(x := rng.random()), float(rng.random()), "yes" if x > 0.5 else "no", 3 * x) for k in range(80)]
    rows += [(100, None, 1.0, "yes", 1.0), (101, float("nan"), 1.0, "no", 1.0), (102, 0.9, 0.1, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y string, t double")
    for kind, label in (("logistic_regression", "y"), ("linear_regression", "t"), ("svc", "y")):
        out = {r.id: r for r in M.predict(M.fit(kind, df, ["a", "b"], label), df, keep=["id"]).collect()}
        assert len(out) == 83 and out[100].pred is None and out[101].pred is None and out[102].pred is not None
        hits = sum(str(out[r[0]].pred) == r[3] for r in rows[:80]) if label == "y" else 80
        assert hits > 70
    found, _ = cl.kmeans(df, ["a", "b"], 2)
    assert found.count() == 83 and found.where("cluster IS NULL").count() == 2
    assert cl.agglomerative(df, ["a", "b"], 2).where("cluster IS NULL").count() == 2


def test_anova_counts_each_feature_by_itself(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.0, 6.0), ("a", 3.0, 1.0), ("b", 5.0, 7.0), ("b", 6.0, None), ("b", 7.0, 8.0), (None, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.feature: r.f_score for r in ft.anova_f(df, "g").collect()}
    assert got["x"] == pytest.approx(24.0)
    # y: a = 5, 6, 1 and b = 7, 8
    assert got["y"] == pytest.approx((3 * (4 - 5.4) ** 2 + 2 * (7.5 - 5.4) ** 2) / ((14 + 0.5) / 3))


def test_resample_leaves_out_null_groups_and_spans_many_bins(spark):
    df = spark.sql("SELECT CAST('2024-01-01' AS TIMESTAMP) + make_interval(0,0,0,0,0,0,id * 5000) AS ts, "
                   "CAST(id AS DOUBLE) AS v, CASE WHEN id % 2 = 0 THEN 'a' END AS g FROM range(5)")
    out = rs.resample_agg(df, "ts", "1S", ("mean",), "g")
    assert out.where("g IS NULL").count() == 0
    assert out.count() == 20001 and out.select("ts").distinct().count() == 20001 and out.where("v_mean IS NOT NULL").count() == 3


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    hub = spark.range(1001, 1400).select(F.lit(1000).cast("long").alias("u"), F.col("id").alias("v"))
    got = {r.node: r.component for r in components(chain.unionByName(hub)).collect()}
    assert got == {**{k: 0 for k in range(300)}, **{k: 1000 for k in range(1000, 1400)}}
    assert components(chain.limit(0)).count() == 0


def test_dbscan_follows_a_chain_to_its_end(spark):
    df = spark.range(1200).select("id", (F.col("id") * 0.4).alias("x"), F.lit(0.0).alias("y"))
    extra = spark.createDataFrame([(5000, None, 1.0), (5001, 9e6, 0.0)], "id long, x double, y double")
    out = cl.dbscan(df.unionByName(extra), "id", ["x", "y"], 0.5, 2)
    got = {r.cluster: r["count"] for r in out.groupBy("cluster").count().collect()}
    assert got == {0: 1200, -1: 2}


def test_dtw_of_all_pairs_and_short_series(spark):
    rows = [(s, t, float((t * k) % 5)) for k, s in enumerate("abcd") for t in range(30)] + [("e", 0, 1.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    got = fc.dtw_distance(df, "t", "v", "s").collect()
    assert len(got) == 10 and all(r.a < r.b and r.dtw >= 0 for r in got)
    auto = fc.auto_forecast(df.where("s IS NOT NULL"), "t", "v", ["s"], 10).collect()
    assert {r.s for r in auto if r.spec == "series too short"} >= {"e"}


def test_arima_of_one_series_short_series_and_order(spark):
    y = [10.0, 12.0, 11.0, 15.0, 14.0, 18.0, 17.0, 21.0, 22.0]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(y)] + [("b", 0, 1.0), ("c", 0, 1.0), ("c", 1, 3.0), ("c", 2, 5.0)],
                               "s string, t int, v double")
    got = {(r.s, r.step): r.forecast for r in fc.arima_forecast(df, "t", "v", ["s"], 3).collect()}
    one = {r.step: r.forecast for r in fc.arima_forecast(df.where("s = 'a'"), "t", "v", (), 3).collect()}
    z = [b - a for a, b in zip(y, y[1:])]
    x, t = z[:-1], z[1:]
    mx, mt = sum(x) / len(x), sum(t) / len(t)
    phi = sum((a - mx) * (b - mt) for a, b in zip(x, t)) / sum((a - mx) ** 2 for a in x)
    level, last, want = y[-1], z[-1], {}
    for k in range(3):
        last = mt - phi * mx + phi * last
        level += last
        want[9 + k] = level
    assert one == pytest.approx(want) and {k: got["a", k] for k in want} == pytest.approx(want)
    assert [got["b", k] for k in (1, 2, 3)] == [None] * 3 and got["c", 3] == pytest.approx(7.0)
    with pytest.raises(ValueError):
        fc.arima_forecast(df, "t", "v", ["s"], 3, (1, 1, 2))
    # the differenced exogenous column drives the differenced value with coefficient 2
    rows = [(k, float(k * k % 7), 2.0 * (k * k % 7) + 5.0 * k) for k in range(30)]
    ex = fc.arima_forecast(spark.createDataFrame(rows, "t int, x double, v double"), "t", "v", (), 4, (0, 1, 0), ["x"]).collect()
    xs = [r[1] for r in rows]
    future, level = xs + xs[-4:], rows[-1][2]
    for k, r in enumerate(sorted(ex, key=lambda r: r.step)):
        level += 2 * (future[30 + k] - future[29 + k]) + 5
        assert r.forecast == pytest.approx(level)


def test_datetimes_with_a_zone_and_real_times(spark):
    from kestrel.functions.scalar import to_datetime
    rows = [("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("2023-12-31T19:30:00.250-04:30",), ("2024-01-01T00:00:00",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "t string").withColumn("r", F.lit("2024-01-01 05:06:07.123456").cast("timestamp"))
    got = to_datetime(df, ["t", "r"]).collect()
    assert [None if r.t is None else r.t.isoformat() for r in got] == [
        "2024-01-01T00:00:00", "2024-01-01T00:00:00", "2024-01-01T00:00:00.250000", "2024-01-01T00:00:00", None, None]
    assert got[0].r.isoformat() == "2024-01-01T05:06:07.123456"


def test_column_json_of_several_files_with_text_labels(spark, tmp_path):
    from kestrel.sources.files import read_json
    (tmp_path / "a.json").write_text('{"x": {"0": 1, "1": 2, "10": 3}, "n": {"0": "p", "1": "q"}}')
    (tmp_path / "b.json").write_text('{"x": {"0": 4, "r1": 5}, "z": {"r1": "w"}}')
    got = [tuple(r) for r in read_json(spark, str(tmp_path), "columns").collect()]
    assert got == [(1.0, "p", None), (2.0, "q", None), (3.0, None, None), (4.0, None, None), (5.0, None, "w")]
