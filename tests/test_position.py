"""Many small range partitions force halo copies and carries across partitions,
and the results must equal the oracle as with few."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from kestrel.operators import position
from oracle import compare

from conftest import SF001

HALO_QUERIES = ["rolling_mean", "interpolate_linear", "acf", "lag_features", "sequence_windows",
                "multi_horizon_dataset"]


@pytest.fixture
def tiny_buckets(monkeypatch):
    monkeypatch.setattr(position, "PARTITIONS", 61)


@pytest.mark.parametrize("name", HALO_QUERIES)
def test_halo_paths_equal_oracle(spark, duck001, tiny_buckets, name):
    df = E.queries()[name](spark, SF001)
    ok, msg = compare(df, duck001, E.oracle_sql()[name])
    assert ok, msg


def test_global_position_is_dense(spark, tiny_buckets):
    e = spark.read.parquet(f"{SF001}/events.parquet")
    p = position.global_position(e, ["event_type"], ["ts", "event_id"])
    chk = p.groupBy("event_type").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"),
                                      F.count("*").alias("n"), F.countDistinct("_pos").alias("d")).collect()
    for r in chk:
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["d"] == r["n"]


def test_dense_index_matches_sorted_distinct(spark):
    e = spark.read.parquet(f"{SF001}/customer.parquet")
    d = position.dense_index(e, "c_name", "i").orderBy("i").collect()
    names = sorted({r["c_name"] for r in e.select("c_name").collect()})
    assert [r["c_name"] for r in d] == names
    assert [r["i"] for r in d] == list(range(len(names)))


@pytest.mark.parametrize("partitions", [1, 7])
def test_null_keys_null_times_and_ties_keep_their_rows(spark, monkeypatch, partitions):
    from kestrel.operators import timeseries as ts
    monkeypatch.setattr(position, "PARTITIONS", partitions)
    rows = [(None if k % 5 == 0 else "ab"[k % 2], None if k % 7 == 0 else k // 4, float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    p = position.global_position(df, ["g"], ["t"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in p if r.g == g), key=lambda r: r._pos)
        assert [r._pos for r in mine] == list(range(sum(x[0] == g for x in rows)))
        keys = [(r.t is not None, r.t or 0) for r in mine]
        assert keys == sorted(keys)
    assert ts.rolling_mean(df, "t", "v", 3, ["g"]).count() == 200
    assert ts.interpolate_linear(df, "t", "v", ["g"]).count() == 200
    assert ts.lag_features(df, "t", "v", 2, 0, series_cols=["g"]).count() == 200 - 2 * 3


def test_equal_order_values_are_spread(spark):
    df = spark.range(2000).select(F.lit(1).alias("t"), "id")
    p = position.global_position(df, [], ["t"], partitions=8, keep_bucket=True)
    sizes = [r["count"] for r in p.groupBy("_bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
    assert sorted(r._pos for r in p.collect()) == list(range(2000))
