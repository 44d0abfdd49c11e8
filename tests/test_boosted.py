"""Boosted regression on sums per cell: MLlib's trees on the binned rows, fitted to cells instead of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

COLS = ["a", "b", "c"]


def _rows(spark, n):
    """7, 30 and 3 distinct values; many rows a cell, with noise that no feature tells."""
    a, b, c = F.col("id") % 7, F.floor(F.col("id") / 7) % 30 / 10, F.floor(F.col("id") / 210) % 3
    noise = 20 * F.sin(F.col("id") * 1.7)
    return spark.range(n).select("id", a.alias("a"), b.alias("b"), c.cast("int").alias("c"),
                                 (10 * a + 3 * b * b + a * b + noise).alias("y"))


@pytest.mark.parametrize("kind", ["lgbm_reg", "xgb_reg", "gradient_boosting_reg"])
def test_boosting_on_cells_is_boosting_on_rows(spark, monkeypatch, tmp_path, kind):
    """The trees read cells, not rows, and predict what trees on the rows predict."""
    from kestrel.ml import forest as fo, models as M
    from kestrel.sources.models import load_model, save_model
    d = _rows(spark, 9_000).cache()
    plain = M.fit(kind, d, COLS, "y", n_estimators=8)
    seen, fit = [], fo.GBTRegressor.fit
    with monkeypatch.context() as m:
        m.setattr(fo, "SUMS_FROM", 0)
        m.setattr(fo.GBTRegressor, "fit", lambda self, x, *a: (seen.append(x.count()), fit(self, x, *a))[1])
        cells = M.fit(kind, d, COLS, "y", n_estimators=8)
    assert seen and max(seen) <= 2 * 7 * 30 * 3
    p, q = (M.predict(x, d, keep=["id"]).toPandas().sort_values("id") for x in (plain, cells))
    assert len(q) == 9_000 and q.pred.nunique() > 20
    np.testing.assert_allclose(q.pred, p.pred, rtol=1e-9)
    i, j = (M.feature_importance(x).toPandas().set_index("feature").importance for x in (plain, cells))
    np.testing.assert_allclose(j[i.index], i, rtol=1e-6)
    save_model(cells, str(tmp_path / "m"))
    again = M.predict(load_model(str(tmp_path / "m")), d.where("id < 5"), keep=["id"]).toPandas().sort_values("id")
    np.testing.assert_allclose(again.pred, q.pred[:5])


def test_points_of_cells_keep_the_sums(spark):
    from kestrel.ml import forest as fo
    rng = np.random.default_rng(3)
    b, y = rng.integers(0, 4, 500), 1e6 + rng.normal(size=500)
    d = spark.createDataFrame([(float(i), float(v)) for i, v in zip(b, y)], "_b0 double, _label double")
    got = fo.cell_points(d, ["_b0"]).toPandas()
    assert len(got) == 8
    for k, g in got.groupby("_b0"):
        own = y[b == k]
        assert g["_weight"].sum() == len(own)
        mean = (g["_weight"] * g["_label"]).sum() / len(own)
        assert mean == pytest.approx(own.mean(), rel=1e-12)
        assert (g["_weight"] * (g["_label"] - mean) ** 2).sum() == pytest.approx(((own - own.mean()) ** 2).sum(), rel=1e-6)
