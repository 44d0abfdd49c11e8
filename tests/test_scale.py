"""Steps that have to stay linear, or defined, on large or one-sided tables."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("group", [None, "g"])
def test_split_decides_rows_where_they_stand(spark, group):
    from kestrel.ml import split as sp
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    parts = sp.stratified_split(df, "g", 0.2, key_cols=["k"]) if group else sp.train_test_split(df, 0.2, key_cols=["k"])
    assert [p.count() for p in parts] == [2400, 600]
    for p in parts:
        assert "SortMergeJoin" not in plan(p) and "hashpartitioning" not in plan(p)


def test_split_of_repeated_keys_equals_sorting(spark):
    from kestrel.operators.features import hash_uniform
    from kestrel.ml import split as sp
    df = spark.range(400).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    tr, te = sp.train_test_split(df, 0.2, key_cols=["k"])
    d = df.withColumn("_u", hash_uniform(42, ["k"])).withColumn("h", F.xxhash64("k", "v", "_u"))
    want = [r.v for r in d.orderBy("_u", "k", "h").limit(math.ceil(0.2 * 400)).collect()]
    got = [r.v for r in te.collect()]
    assert sorted(got) == sorted(want) and sorted(got + [r.v for r in tr.collect()]) == list(range(400))


def test_auc_of_one_class_is_null(spark):
    from kestrel.operators import metrics
    one = spark.createDataFrame([(1, 0.5), (1, 0.25)], "y int, score double")
    assert metrics.roc_auc(one).first()[0] is None


def test_sequence_classifier_scores_a_test_part_without_positives(spark, tmp_path):
    from kestrel.plans.catalog_ml import q_sequence_classifier
    rows = spark.range(24 * 6).select(F.timestamp_seconds(F.col("id") * 3600 + 1704067200).alias("ts"),
                                      (F.col("id") % 5 + 1).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    r = q_sequence_classifier(spark, str(tmp_path)).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.auc) == (1.0, 0.0, 0.0, 0.0, None)


@pytest.mark.parametrize("d", [2, 6])
def test_neighbours_of_repeated_points_and_ids(spark, d):
    from kestrel.ml.neighbors import knn
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(40, d)), 1)
    x[:15] = x[0]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(i, *map(float, x[i])) for i in range(0, 40, 3)]
    cols = [f"c{k}" for k in range(d)]
    df = spark.createDataFrame(rows, ["id", *cols]).repartition(3)
    got = {}
    for r in knn(df, df, "id", cols, 5, exclude_self=True).collect():
        got.setdefault(r.id, []).append((r._rank, r._dist, r.nn_id))
    for q in range(40):
        near = [(float(np.sqrt(np.cumsum((np.array(r[1:]) - x[q]) ** 2)[-1])), r[0]) for r in rows if r[0] != q]
        near = sorted(near * sum(r[0] == q for r in rows))[:5]
        if d > 4:       # each brings all rows of its id
            assert sorted((b, c) for _, b, c in got[q]) == sorted(x for x in near for r in rows if r[0] == x[1])
            continue
        assert [(a, b) for _, a, b in sorted(got[q])] == near


def test_smallest_distances_hold_all_ties():
    from kestrel.ml.pivots import _smallest, squares
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (50, 4)).astype(float) + 1e6, rng.integers(0, 3, (300, 4)).astype(float) + 1e6
    d = np.sqrt(squares(x, y))
    got = {(i, j): v for i, j, v in zip(*(np.concatenate(c) for c in zip(*_smallest(x, y, 4, np.full(50, np.inf)))))}
    for i in range(50):
        for j in np.flatnonzero(d[i] <= np.sort(d[i])[3]):
            assert got[i, j] == d[i, j]
