"""Cross-validation: folds by hash order (stratified for classifiers), one
distributed fit per fold, accuracy or R^2, mean and population std."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models as M
from .split import fold_ids


def cross_validate(kind: str, df: DataFrame, feature_cols, label: str, k: int = 5, seed: int = 42,
                   key_cols=None, **params) -> DataFrame:
    """(fold, score) rows plus summary columns mean and std (population)."""
    classify = kind in M.CLASSIFIERS
    f = fold_ids(df, k, target=label if classify else None, seed=seed, key_cols=key_cols)
    scores = []
    for i in range(k):
        m = M.fit(kind, f.where(F.col("fold") != i), feature_cols, label, seed=seed, **params)
        p = M.predict(m, f.where(F.col("fold") == i))
        if classify:
            s = p.agg(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0]
        else:
            r = p.agg(F.sum((F.col("y") - F.col("pred")) ** 2).alias("sse"), F.var_pop("y").alias("v"),
                      F.count(F.lit(1)).alias("n")).first()
            s = 1 - r["sse"] / (r["v"] * r["n"]) if r["v"] else None
        scores.append(s)
    valid = [s for s in scores if s is not None]
    mean = sum(valid) / len(valid) if valid else None
    std = math.sqrt(sum((s - mean) ** 2 for s in valid) / len(valid)) if valid else None
    metric = "accuracy" if classify else "r2"
    return df.sparkSession.createDataFrame([(i, metric, s, mean, std) for i, s in enumerate(scores)],
                                           "fold int, metric string, score double, mean double, std double")
