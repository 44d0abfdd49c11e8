"""Exact quantiles equal numpy, also where one value fills most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kestrel.functions import quantiles as Q

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
COLS = ["l_quantity", "l_extendedprice", "l_orderkey"]


@pytest.fixture(scope="module")
def li(spark):
    return spark.read.parquet(f"{SF001}/lineitem.parquet")


def test_global(li):
    pdf = li.select(*COLS).toPandas()
    got = Q.quantile_values(li, COLS, PROBS)
    for c in COLS:
        assert np.allclose(got[c], np.quantile(pdf[c].to_numpy(), PROBS), rtol=0, atol=1e-9)


def test_grouped(li):
    q = Q.quantiles_long(li, ["l_extendedprice"], PROBS, by=["l_returnflag"]).collect()
    pdf = li.select("l_returnflag", "l_extendedprice").toPandas()
    assert len(q) == len(PROBS) * pdf.l_returnflag.nunique()
    for r in q:
        v = pdf[pdf.l_returnflag == r["l_returnflag"]].l_extendedprice.to_numpy()
        assert r["quantile"] == pytest.approx(np.quantile(v, r["prob"]), abs=1e-9)
        assert r["n"] == len(v)


def test_hot_value_null_and_nan(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, F.lit(7.0)).when(F.col("id") % 20 == 9, F.lit(None)).when(
            F.col("id") % 40 == 19, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("x"),
        F.when(F.col("id") % 3 == 0, "a").alias("g"), F.lit(None).cast("double").alias("none"))
    pdf = df.toPandas()
    v = pdf.x.dropna().to_numpy()
    got = Q.quantile_values(df, ["x", "none"], PROBS)
    assert np.allclose(got["x"], np.quantile(v, PROBS)) and got["none"] == [None] * len(PROBS)
    for r in Q.quantiles_long(df, ["x"], [0.97], by=["g"]).collect():
        g = pdf[pdf.g.isna() if r["g"] is None else pdf.g == r["g"]].x.dropna().to_numpy()
        assert r["n"] == len(g) and r["quantile"] == pytest.approx(np.quantile(g, 0.97))
