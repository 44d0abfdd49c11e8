"""Regression forest on sums per cell: the same forest as MLlib's up to its draws, over cells instead of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _rows(spark, n):
    """7, 101 and 3 distinct values; y depends on the first most, on the last not at all."""
    a, b, c = F.col("id") % 7, (F.col("id") * 37 % 101) / 10, F.col("id") % 3
    return spark.range(n).select(a.alias("a"), b.alias("b"), c.cast("int").alias("c"),
                                 (10 * a + 3 * b + F.sin(F.col("id"))).alias("y"))


def _fit_rows(monkeypatch, spark, n):
    from kestrel.ml import forest as fo, models as M
    seen = []
    fit = fo.RandomForestRegressor.fit

    def spy(self, d, *a):
        seen.append(d.count())
        return fit(self, d, *a)

    with monkeypatch.context() as m:
        m.setattr(fo, "SUMS_FROM", 0)
        m.setattr(fo.RandomForestRegressor, "fit", spy)
        model = M.fit("random_forest_reg", _rows(spark, n), ["a", "b", "c"], "y", n_estimators=4)
    return model, seen


def test_trees_read_cells_not_rows(spark, monkeypatch):
    model, seen = _fit_rows(monkeypatch, spark, 20_000)
    assert len(seen) == 4
    assert max(seen) <= 2 * 7 * 32 * 3
    assert len([s for s in model.pipeline.stages if hasattr(s, "featureImportances")]) == 4


def test_agrees_with_the_forest_on_rows(spark, monkeypatch, tmp_path):
    from kestrel.ml import forest as fo, models as M
    from kestrel.sources.models import load_model, save_model
    d = _rows(spark, 3_000)
    plain = M.fit("random_forest_reg", d, ["a", "b", "c"], "y", n_estimators=20)
    monkeypatch.setattr(fo, "SUMS_FROM", 0)
    sums = M.fit("random_forest_reg", d, ["a", "b", "c"], "y", n_estimators=20)
    i, j = (M.feature_importance(m).toPandas().set_index("feature").importance for m in (plain, sums))
    assert j.sum() == pytest.approx(1.0)
    assert list(i.index) == list(j.index) and np.abs(i - j).max() < 0.1
    p, q = (M.predict(m, d.withColumn("k", F.monotonically_increasing_id()), keep=["k"]).toPandas().sort_values("k")
            for m in (plain, sums))
    r2 = [1 - ((x.y - x.pred) ** 2).sum() / ((x.y - x.y.mean()) ** 2).sum() for x in (p, q)]
    assert r2[1] > r2[0] - 0.05
    save_model(sums, str(tmp_path / "m"))
    again = M.predict(load_model(str(tmp_path / "m")), d.limit(5)).toPandas()
    np.testing.assert_allclose(again.pred, M.predict(sums, d.limit(5)).toPandas().pred)


def test_every_row_is_counted_in_every_tree(spark):
    """Sums of a cell add up over batches and tasks; k equal rows count Poisson(k) times."""
    from kestrel.ml import forest as fo
    d = spark.range(30_000).select((F.col("id") % 2).cast("double").alias("_b0"),
                                   F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("_label"))
    n_trees = 50
    s = fo.cell_sums(d, ["_b0"], [[0.5]], n_trees, 42).toPandas()
    assert len(s) == 2 * n_trees and not s.duplicated(["_tree", "_cell"]).any()
    same, own = s[s["_cell"] == 0], s[s["_cell"] == 1]
    np.testing.assert_allclose(same["_wy"], 5 * same["_w"])
    np.testing.assert_allclose(same["_wyy"], 25 * same["_w"])
    for g in (same, own):           # Poisson(15,000): mean and deviation over the trees
        assert abs(g["_w"].mean() - 15_000) < 5 * (15_000 / n_trees) ** 0.5
        assert 70 < g["_w"].std() < 190
    assert (own["_wy"] / own["_w"]).mean() == pytest.approx(15_000, abs=60)


def test_bin_edges_keep_few_values_apart(spark):
    from kestrel.ml import forest as fo
    d = spark.range(50_000).select(F.when(F.col("id") == 7, 9.0).otherwise(F.col("id") % 3).alias("rare"),
                                   (F.col("id") * 1.0).alias("many"), F.lit(4).alias("one"))
    rare, many, one = fo.bin_edges(d, ["rare", "many", "one"])
    assert rare == [0.5, 1.5, 5.5]
    assert len(many) == 31 and np.abs(np.diff([0, *many, 50_000]) - 50_000 / 32).max() < 150
    assert len(one) == 1
