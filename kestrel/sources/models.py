"""Saving and loading fitted models with MLlib's writer (no pickles)."""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model, path: str) -> str:
    """Pipeline under ``path/pipeline``, reading metadata under ``path/meta``."""
    spark = SparkSession.getActiveSession()
    model.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
    meta = {"kind": model.kind, "feature_cols": model.feature_cols, "label_col": model.label_col,
            "extra": model.extra}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
         .write.mode("overwrite").json(os.path.join(path, "meta"))
    return path


def load_model(path: str):
    from ..ml.models import Model
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
    pm = PipelineModel.load(os.path.join(path, "pipeline"))
    return Model(meta["kind"], pm, meta["feature_cols"], meta["label_col"], meta["extra"])
