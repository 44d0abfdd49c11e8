"""Registered queries (see registry.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, rounded
from .fixtures import tables
from ..sources import files as fs
from ..sources.models import load_model, save_model


@query("read_csv", "SELECT * FROM customer")
def q_read_csv(spark, sf_dir):
    """customer written as CSV (header) and read back with inferred types."""
    p = fs.scratch_path(spark, "customer-csv")
    fs.write_stage(tables(spark, sf_dir).customer, p, "csv")
    return fs.read_csv(spark, p)


@query("read_json", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, "
       "CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def q_read_json(spark, sf_dir):
    """nation written as JSON lines and read back."""
    p = fs.scratch_path(spark, "nation-json")
    fs.write_stage(tables(spark, sf_dir).nation, p, "json")
    return fs.read_json(spark, p).select("n_nationkey", "n_name", "n_regionkey")


@query("read_source", "SELECT * FROM supplier")
def q_read_source(spark, sf_dir):
    """Reader chosen by file name: supplier.csv."""
    p = fs.scratch_path(spark, "supplier.csv")
    fs.write_stage(tables(spark, sf_dir).supplier, p, "csv")
    return fs.read_source(spark, p)


@query("write_stage", "SELECT * FROM orders")
def q_write_stage(spark, sf_dir):
    """orders persisted as a parquet stage and read back."""
    p = fs.scratch_path(spark, "orders-stage")
    fs.write_stage(tables(spark, sf_dir).orders, p, "parquet")
    return fs.read_stage(spark, p, "parquet")


@query("save_model")
def q_save_model(spark, sf_dir):
    """Logistic regression on embedding coordinates saved, loaded and applied."""
    from ..ml import models as M
    from .catalog_ml import _EMB_COLS, _emb
    emb = _emb(spark, sf_dir)
    m = M.fit("logistic_regression", emb, _EMB_COLS, "label")
    p = fs.scratch_path(spark, "model")
    save_model(m, p)
    return M.predict(load_model(p), emb, keep=["vec_id"])
