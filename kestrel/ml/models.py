"""Supervised models on MLlib, with the reference's default hyper-parameters.

Every model is a ``Pipeline``: label indexing (sorted labels), feature
assembly, the estimator, and label decoding, so that ``transform`` returns
``prediction_label`` in the original label space and the fitted object can
be saved with MLlib's writer.

Stand-ins (documented, not numerically equal to the reference's libraries):
gradient-boosted trees for XGBoost / LightGBM, random Fourier features with
linear SVM / epsilon-insensitive regression for RBF SVC / SVR, a multilayer
perceptron on flattened windows for the LSTM classifier.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import is_numeric, stats_row
from . import forest

# Fixed defaults of the reference (its model menu).
DEFAULTS = {
    "logistic_regression": {"C": 1.0},
    "random_forest_clf": {"n_estimators": 100, "max_depth": 5},
    "gradient_boosting_clf": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "xgb_clf": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 3},
    "lgbm_clf": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
    "svc": {"C": 1.0},
    "knn_classifier": {"n_neighbors": 5},
    "linear_regression": {},
    "random_forest_reg": {"n_estimators": 100, "max_depth": 5},
    "gradient_boosting_reg": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "xgb_reg": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 3},
    "lgbm_reg": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
    "svr": {"C": 1.0, "epsilon": 0.1},
}
ON_SUMS = ("random_forest_reg", "gradient_boosting_reg", "xgb_reg", "lgbm_reg")     # may be fitted to sums per cell of binned features
CLASSIFIERS = ("logistic_regression", "random_forest_clf", "gradient_boosting_clf", "xgb_clf", "lgbm_clf", "svc")
REGRESSORS = ("linear_regression", "random_forest_reg", "gradient_boosting_reg", "xgb_reg", "lgbm_reg")


def features_vector(df: DataFrame, feature_cols, out: str = "features") -> DataFrame:
    """Numeric columns, or one array column, as an MLlib vector column."""
    feature_cols = [feature_cols] if isinstance(feature_cols, str) else list(feature_cols)
    if len(feature_cols) == 1 and df.schema[feature_cols[0]].dataType.typeName() == "array":
        return df.withColumn(out, array_to_vector(F.col(feature_cols[0]).cast("array<double>")))
    return _assemble(df, feature_cols, out)


def split_complete(df: DataFrame, feature_cols) -> tuple[DataFrame, DataFrame]:
    """(rows with all features known, the other rows): NULL and NaN count as missing."""
    cols = [feature_cols] if isinstance(feature_cols, str) else list(feature_cols)
    known = lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
    ok = F.lit(True)
    for c in cols:
        if df.schema[c].dataType.typeName() == "array":
            ok = ok & F.col(c).isNotNull() & F.coalesce(F.forall(c, known), F.lit(False))
        else:
            ok = ok & known(F.col(c))
    return df.where(ok), df.where(~ok)


def _assemble(df, cols, out):
    tmp = [f"__f{i}" for i in range(len(cols))]
    d = df.select("*", *[F.col(c).cast("double").alias(t) for c, t in zip(cols, tmp)])
    return VectorAssembler(inputCols=tmp, outputCol=out, handleInvalid="error").transform(d).drop(*tmp)


def _estimator(kind: str, n_rows: int, n_classes: int, seed: int, params: dict):
    p = {**DEFAULTS.get(kind, {}), **params}
    if kind == "logistic_regression":
        return LogisticRegression(featuresCol="features", labelCol="_label", regParam=1.0 / (p["C"] * max(n_rows, 1)),
                                  elasticNetParam=0.0, standardization=False, maxIter=200,
                                  family="multinomial" if n_classes > 2 else "binomial")
    if kind == "random_forest_clf":
        return RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=p["n_estimators"],
                                      maxDepth=p["max_depth"], seed=seed)
    if kind in ("gradient_boosting_clf", "xgb_clf", "lgbm_clf"):
        g = GBTClassifier(featuresCol="features", labelCol="_label", maxIter=p["n_estimators"],
                          stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=seed)
        return g if n_classes <= 2 else OneVsRest(classifier=g, featuresCol="features", labelCol="_label",
                                                  parallelism=min(n_classes, 8))
    if kind == "svc":
        s = LinearSVC(featuresCol="features", labelCol="_label", regParam=1.0 / (p["C"] * max(n_rows, 1)),
                      maxIter=100)
        return s if n_classes <= 2 else OneVsRest(classifier=s, featuresCol="features", labelCol="_label",
                                                  parallelism=min(n_classes, 8))
    if kind == "linear_regression":
        return LinearRegression(featuresCol="features", labelCol="_label", regParam=0.0, solver="normal")
    if kind == "random_forest_reg":
        return RandomForestRegressor(featuresCol="features", labelCol="_label", numTrees=p["n_estimators"],
                                     maxDepth=p["max_depth"], seed=seed)
    if kind in ("gradient_boosting_reg", "xgb_reg", "lgbm_reg"):
        return GBTRegressor(featuresCol="features", labelCol="_label", maxIter=p["n_estimators"],
                            stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=seed)
    raise ValueError(f"unknown model {kind!r}")


def _on_sums(kind: str, d: DataFrame, feature_cols, n_rows: int, seed: int, params: dict) -> PipelineModel | None:
    """Regression forest or boosted trees on sums per cell, where rows times trees are more than
    ``forest.SUMS_FROM`` and the features have at most ``forest.MAX_CELLS`` cells; else None."""
    p = {**DEFAULTS[kind], **params}
    cols = [feature_cols] if isinstance(feature_cols, str) else list(feature_cols)
    if n_rows * p["n_estimators"] <= forest.SUMS_FROM or not all(is_numeric(d, c) for c in cols):
        return None
    if 2 ** len(cols) > forest.MAX_CELLS:      # each column has two bins or more
        return None
    edges = forest.bin_edges(d, cols)
    if forest.n_cells(edges) > forest.MAX_CELLS:
        return None
    if kind == "random_forest_reg":
        return forest.fit_forest(d, cols, edges, p["n_estimators"], p["max_depth"], seed)
    return forest.fit_boosted(d, cols, edges, p["n_estimators"], p["learning_rate"], p["max_depth"], seed)


class Model:
    """A fitted pipeline plus what is needed to read its output."""

    def __init__(self, kind, pipeline: PipelineModel, feature_cols, label_col, extra=None):
        self.kind, self.pipeline = kind, pipeline
        self.feature_cols, self.label_col = list(feature_cols), label_col
        self.extra = extra or {}

    def transform(self, df: DataFrame) -> DataFrame:
        d = df
        if "rff" in self.extra:
            d = rff_features(d, self.feature_cols, params=self.extra["rff"])
        else:
            d = features_vector(d, self.feature_cols)
        return self.pipeline.transform(d)

    @property
    def estimator_model(self):
        return self.pipeline.stages[0]


def fit(kind: str, train: DataFrame, feature_cols, label_col: str, seed: int = 42, **params) -> Model:
    """Fit a classifier (label indexed, decoded as ``prediction_label``) or regressor.

    Rows with a missing feature or label take no part in the fit.
    """
    extra = {}
    train, _ = split_complete(train.where(F.col(label_col).isNotNull()), feature_cols)
    if kind == "svc":
        from ..session import cut_lineage
        extra["rff"] = fit_rff(train, feature_cols, seed=seed)
        # features are used by every solver iteration: materialise them once
        d = cut_lineage(rff_features(train, feature_cols, params=extra["rff"]))
    else:
        d = features_vector(train, feature_cols)
    # two solvers state their penalty per row, trees go by rows or by cells
    n = d.count() if kind in ("logistic_regression", "svc", *ON_SUMS) else 0
    if kind in CLASSIFIERS:
        # labels are indexed for training only (sorted, strict); the pipeline
        # keeps estimator + decoder, so scoring needs no label column
        idx = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc",
                            handleInvalid="error").fit(d)
        k = len(idx.labels)
        est = _estimator(kind, n, k, seed, params)
        dec = IndexToString(inputCol="prediction", outputCol="prediction_label", labels=idx.labels)
        pm = Pipeline(stages=[est, dec]).fit(idx.transform(d))
    elif kind in REGRESSORS:
        d = d.withColumn("_label", F.col(label_col).cast("double"))
        pm = _on_sums(kind, d, feature_cols, n, seed, params) if kind in ON_SUMS else None
        if pm is None:
            pm = Pipeline(stages=[_estimator(kind, n, 0, seed, params)]).fit(d)
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Model(kind, pm, feature_cols, label_col, extra)


def predict(model: Model, df: DataFrame, keep=()) -> DataFrame:
    """(keep..., y, pred[, score]) for metrics: the label and the prediction.

    Every row comes back; one with a missing feature has a NULL prediction.
    """
    from pyspark.ml.functions import vector_to_array
    ok, missing = split_complete(df, model.feature_cols)
    out = model.transform(ok)
    if model.kind in CLASSIFIERS:
        cols = [*keep, F.col(model.label_col).cast("string").alias("y"), F.col("prediction_label").alias("pred")]
        empty = [*keep, F.col(model.label_col).cast("string").alias("y"), F.lit(None).cast("string").alias("pred")]
        if "probability" in out.columns:
            cols.append(vector_to_array("probability").alias("proba"))
            empty.append(F.lit(None).cast("array<double>").alias("proba"))
        elif "rawPrediction" in out.columns:
            # margins rank rows as well as probabilities do, so AUC needs no more
            cols.append(vector_to_array("rawPrediction").alias("score"))
            empty.append(F.lit(None).cast("array<double>").alias("score"))
        return out.select(*cols).unionByName(missing.select(*empty))
    y = F.col(model.label_col).cast("double").alias("y")
    return out.select(*keep, y, F.col("prediction").alias("pred")).unionByName(
        missing.select(*keep, y, F.lit(None).cast("double").alias("pred")))


def feature_importance(model: Model) -> DataFrame:
    """(feature, importance) for tree models (original feature names)."""
    forests = [m for m in model.pipeline.stages if hasattr(m, "featureImportances")]
    if not forests:
        raise ValueError(f"{model.kind} has no feature importances")
    imp = sum(m.featureImportances.toArray() for m in forests)
    if len(forests) > 1:       # one stage per tree: their mean, as MLlib's own forest has it
        imp = imp / (imp.sum() or 1.0)
    imp = imp.tolist()
    names = model.feature_cols if len(model.feature_cols) == len(imp) else [f"f{i}" for i in range(len(imp))]
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().createDataFrame(list(zip(names, [float(v) for v in imp])),
                                                           "feature string, importance double")


# ------------------------------------------------ random Fourier features

def fit_rff(df: DataFrame, cols, n_components: int = 100, gamma=None, seed: int = 42) -> dict:
    """Random Fourier features for the RBF kernel exp(-gamma |x - y|^2).

    gamma defaults to 1 / (d * Var(X)) over all feature values (the 'scale'
    rule of common SVM libraries). The d x D projection is drawn once from a
    seeded generator; its size depends on the feature count only.
    """
    cols = list(cols)
    d = len(cols)
    if gamma is None:
        r = stats_row(df, {"m": F.avg(sum(F.col(c).cast("double") for c in cols) / d),
                           "q": F.avg(sum(F.col(c).cast("double") ** 2 for c in cols) / d)})
        var = (r["q"] or 0) - (r["m"] or 0) ** 2
        gamma = 1.0 / (d * var) if var > 0 else 1.0
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2 * gamma), size=(n_components, d))
    b = rng.uniform(0, 2 * np.pi, size=n_components)
    return {"W": W.tolist(), "b": b.tolist(), "gamma": gamma}


def rff_features(df: DataFrame, cols, params: dict, out: str = "features") -> DataFrame:
    """z(x) = sqrt(2/D) cos(W x + b) as a vector column.

    Computed per Arrow batch as one numpy matrix product (D x d numbers are
    shipped with the function); as SQL expressions the D cosines of d-term
    sums overflow the generated code of one stage.
    """
    cols = list(cols)
    W = np.asarray(params["W"], dtype=float)
    b = np.asarray(params["b"], dtype=float)
    s = float(np.sqrt(2.0 / len(b)))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, W.shape[1]))
        Z = s * np.cos(X @ W.T + b)
        return pd.Series(list(Z))

    xa = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn(out, array_to_vector(project(xa)))


def fit_svr(train: DataFrame, cols, label_col: str, C: float = 1.0, epsilon: float = 0.1,
            n_components: int = 100, iters: int = 100, seed: int = 42) -> dict:
    """Epsilon-insensitive regression on random Fourier features.

    Minimises the sum form 0.5 |w|^2 + C * sum(max(0, |y - w.z - b| - epsilon)),
    divided by C n, with sub-gradient steps s / sqrt(t): one step moves a prediction
    by about its length, as |z| is at most sqrt(2), so s is the deviation of y. The
    mean of the second half of the iterates is returned, for which the usual
    1 / sqrt(iters) bound holds. The features z are materialised once in the
    shared checkpoint folder; every step is then ONE aggregation (a vector mean
    of the sub-gradient) and the D + 1 weights live on the driver. Rows with a
    missing feature or label take no part.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    from ..session import cut_lineage
    train, _ = split_complete(train.where(F.col(label_col).isNotNull()), cols)
    rff = fit_rff(train, cols, n_components, seed=seed)
    z = rff_features(train, cols, rff, out="_z")
    z = cut_lineage(z.select(vector_to_array("_z").alias("_z"), F.col(label_col).cast("double").alias("_y")))
    stats = z.agg(F.count("_y").alias("n"), F.avg("_y").alias("m"), F.stddev_pop("_y").alias("s")).first()
    w, b = np.zeros(n_components), float(stats["m"] or 0.0)
    penalty = 1.0 / (C * max(stats["n"], 1))
    kept, total_w, total_b = 0, np.zeros(n_components), 0.0
    for t in range(1, iters + 1):
        wl = F.array(*[F.lit(float(v)) for v in w])
        pred = F.aggregate(F.zip_with("_z", wl, lambda a, c: a * c), F.lit(0.0), lambda acc, x: acc + x) + F.lit(b)
        r = F.col("_y") - pred
        g = F.when(r > epsilon, -1.0).when(r < -epsilon, 1.0).otherwise(0.0)
        step_df = z.select(g.alias("_g"), "_z").select(
            array_to_vector(F.transform("_z", lambda v: v * F.col("_g"))).alias("_gz"), "_g")
        row = step_df.agg(Summarizer.mean(F.col("_gz")).alias("m"), F.avg("_g").alias("gb")).first()
        if row["gb"] is None:
            break
        step = float(stats["s"] or 0.0) / math.sqrt(t)
        w = w - step * (penalty * w + row["m"].toArray())
        b = b - step * row["gb"]
        if 2 * t > iters:
            kept, total_w, total_b = kept + 1, total_w + w, total_b + b
    if kept:
        w, b = total_w / kept, total_b / kept
    return {"rff": rff, "w": w.tolist(), "b": b, "cols": list(cols)}


def predict_svr(params: dict, df: DataFrame, label_col: str | None = None, keep=()) -> DataFrame:
    """(keep..., y, pred); rows with a missing feature have a NULL prediction."""
    from pyspark.ml.functions import vector_to_array
    df, missing = split_complete(df, params["cols"])
    z = rff_features(df, params["cols"], params["rff"], out="_z").withColumn("_z", vector_to_array("_z"))
    pred = sum(F.col("_z")[j] * F.lit(float(v)) for j, v in enumerate(params["w"])) + F.lit(params["b"])
    cols = [*keep]
    if label_col:
        cols.append(F.col(label_col).cast("double").alias("y"))
    return z.select(*cols, pred.alias("pred")).unionByName(missing.select(*cols, F.lit(None).cast("double").alias("pred")))


# --------------------------------------------------- sequence classifier

def fit_sequence_classifier(seq_df: DataFrame, window: int, n_features: int, hidden=(32,), seed: int = 42,
                            max_iter: int = 100):
    """Binary classifier on flattened past windows (stand-in for the LSTM):
    ``seq`` (window x features) -> ``label`` with a multilayer perceptron."""
    d = seq_df.withColumn("features", array_to_vector(F.flatten("seq"))).withColumn("_label", F.col("label").cast("double"))
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="_label",
                                         layers=[window * n_features, *hidden, 2], seed=seed, maxIter=max_iter)
    return mlp.fit(d)


def predict_sequence_classifier(model, seq_df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    d = seq_df.withColumn("features", array_to_vector(F.flatten("seq")))
    return model.transform(d).select(F.col("label").cast("string").alias("y"),
                                     F.col("prediction").cast("int").cast("string").alias("pred"),
                                     vector_to_array("probability")[1].alias("score"))
