"""Registered queries (see registry.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, rounded
from .fixtures import tables
from ..operators import profile as pr
from .fixtures import EVENTS_DUPS, EVENTS_NULLS, events_dups, events_nulls, with_ctes

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
EVENTS_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]


def _union(parts):
    return "\nUNION ALL ".join(parts)


@query("shape", "SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem")
def q_shape(spark, sf_dir):
    """Rows and columns of lineitem."""
    return pr.shape(tables(spark, sf_dir).lineitem)


@query("head_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_head(spark, sf_dir):
    """First 5 orders by o_orderkey (the feature is a limit)."""
    return pr.head_rows(tables(spark, sf_dir).orders, "o_orderkey", 5)


@query("tail_rows", "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5) ORDER BY o_orderkey")
def q_tail(spark, sf_dir):
    """Last 5 orders by o_orderkey."""
    return pr.tail_rows(tables(spark, sf_dir).orders, "o_orderkey", 5)


_DESC_PARTS = [f"""SELECT '{c}' AS "column", count({c}) AS count,
       round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std,
       round(min({c}::DOUBLE), 6) AS min,
       round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
       round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
       round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75,
       round(max({c}::DOUBLE), 6) AS max FROM lineitem""" for c in LINEITEM_NUM]


@query("describe_numeric", _union(_DESC_PARTS))
def q_describe(spark, sf_dir):
    """count/mean/std/min/quartiles/max of every numeric lineitem column."""
    return rounded(pr.describe_numeric(tables(spark, sf_dir).lineitem))


@query("null_counts", with_ctes(EVENTS_NULLS) + _union(
    [f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM events_nulls"""
     for c in EVENTS_COLS]))
def q_null_counts(spark, sf_dir):
    """Nulls per column of events with every 13th value missing."""
    return pr.null_counts(events_nulls(tables(spark, sf_dir)))


@query("distinct_counts", _union(
    [f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM orders""" for c in ORDERS_COLS]))
def q_distinct(spark, sf_dir):
    """Distinct non-null values per column of orders."""
    return pr.distinct_counts(tables(spark, sf_dir).orders)


@query("duplicate_count", with_ctes(EVENTS_DUPS) + """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM events_dups GROUP BY event_id, ts, user_id, event_type, value, props)""")
def q_dups(spark, sf_dir):
    """Rows equal to an earlier row in events plus a copy of every 10th event."""
    return pr.duplicate_count(events_dups(tables(spark, sf_dir)))


_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("class_distribution", """
WITH l AS (""" + _union([f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM documents"""
                         for c in _DOC_COLS]) + """),
g AS (SELECT "column", value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", value, count FROM (
  SELECT *, count(*) OVER (PARTITION BY "column") AS k FROM g) WHERE k <= 20""")
def q_class_distribution(spark, sf_dir):
    """Value counts of every documents column with at most 20 distinct values."""
    return pr.class_distribution(tables(spark, sf_dir).documents)


@query("null_columns", with_ctes(EVENTS_NULLS) + "SELECT * FROM (" + _union(
    [f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM events_nulls"""
     for c in EVENTS_COLS]) + ") WHERE n_null > 0")
def q_null_columns(spark, sf_dir):
    """Only the columns of events_nulls that have NULLs."""
    return pr.null_counts(events_nulls(tables(spark, sf_dir)), only_missing=True)
