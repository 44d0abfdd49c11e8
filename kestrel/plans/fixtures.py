"""Derived inputs for operators that the clean test tables cannot exercise.

Each fixture keeps every row of its source table (no sampling, no id subsets);
it only adds what the operator needs to meet: NULLs, duplicate rows, invalid
text, a constant column, prediction columns. The Spark builder and the SQL
text (used as a CTE in the DuckDB oracle) are the same expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables


def events_nulls(t: Tables) -> DataFrame:
    e = t.events
    return e.withColumn("value", F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("double"))
                        .otherwise(F.col("value")))


EVENTS_NULLS = """events_nulls AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value, props
  FROM events)"""


def events_dups(t: Tables) -> DataFrame:
    e = t.events
    return e.unionByName(e.where(F.col("event_id") % 10 == 0))


EVENTS_DUPS = """events_dups AS (
  SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)"""


def hourly(t: Tables) -> DataFrame:
    e = t.events
    return (e.groupBy(F.window("ts", "1 hour").start.alias("ts"))
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))


HOURLY = """hourly AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, avg(value) AS value, count(*) AS n
  FROM events GROUP BY 1)"""


def hourly_by_type(t: Tables) -> DataFrame:
    e = t.events
    return (e.groupBy("event_type", F.window("ts", "1 hour").start.alias("ts"))
            .agg(F.avg("value").alias("value")))


HOURLY_BY_TYPE = """hourly_by_type AS (
  SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(value) AS value
  FROM events GROUP BY 1, 2)"""


def user_daily(t: Tables) -> DataFrame:
    e = t.events
    return (e.groupBy("user_id", F.window("ts", "1 day").start.alias("ts"))
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")))


USER_DAILY = """user_daily AS (
  SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS ts, sum(value) AS value, count(*) AS n
  FROM events GROUP BY 1, 2)"""


def lineitem_const(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("const_col", F.lit(1.0))


LINEITEM_CONST = """lineitem_const AS (SELECT *, 1.0::DOUBLE AS const_col FROM lineitem)"""


def text_numbers(t: Tables) -> DataFrame:
    e = t.events
    return e.select("event_id", "ts", "event_type",
                    F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
                    .otherwise(F.col("value").cast("string")).alias("value_text"))


TEXT_NUMBERS = """text_numbers AS (
  SELECT event_id, ts, event_type,
         CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_text
  FROM events)"""


def text_dates(t: Tables) -> DataFrame:
    e = t.events
    return e.select("event_id", "value",
                    F.when(F.col("event_id") % 11 == 0, F.lit("bad"))
                    .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("ts_text"))


TEXT_DATES = """text_dates AS (
  SELECT event_id, value,
         CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text
  FROM events)"""


def pred_binary(t: Tables) -> DataFrame:
    e = t.events
    return e.select("event_id", (F.col("value") > 35).cast("int").alias("y"),
                    (F.col("value") / 500).alias("score"),
                    (F.col("value") > 40).cast("int").alias("pred"))


PRED_BINARY = """pred_binary AS (
  SELECT event_id, CAST(value > 35 AS INTEGER) AS y, value / 500 AS score,
         CAST(value > 40 AS INTEGER) AS pred FROM events)"""


def pred_reg(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(F.col("l_extendedprice").alias("y"),
                     (F.col("l_extendedprice") * (1 + (F.col("l_linenumber") - 3) * 0.01)).alias("pred"))


PRED_REG = """pred_reg AS (
  SELECT l_extendedprice AS y, l_extendedprice * (1 + (l_linenumber - 3) * 0.01) AS pred
  FROM lineitem)"""


# Fixed rule of this fixture: a flag is "shifted" to the next one in A -> N -> R -> A.
def pred_multi(t: Tables) -> DataFrame:
    li = t.lineitem
    shifted = (F.when(F.col("l_returnflag") == "A", "N").when(F.col("l_returnflag") == "N", "R")
               .otherwise("A"))
    pred = F.when(F.col("l_orderkey") % 5 == 0, shifted).otherwise(F.col("l_returnflag"))
    out = li.select(F.col("l_returnflag").alias("y"), pred.alias("pred"), "l_discount")
    # class scores: the predicted class gets 0.5 + discount, the others share the rest
    return out.select("y", "pred", *[
        F.when(F.col("pred") == c, 0.5 + F.col("l_discount")).otherwise((0.5 - F.col("l_discount")) / 2)
        .alias(f"score_{c}") for c in ("A", "N", "R")])


PRED_MULTI = """pred_multi0 AS (
  SELECT l_returnflag AS y,
         CASE WHEN l_orderkey % 5 = 0 THEN
              CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END
              ELSE l_returnflag END AS pred, l_discount
  FROM lineitem),
pred_multi AS (
  SELECT y, pred,
    CASE WHEN pred = 'A' THEN 0.5 + l_discount ELSE (0.5 - l_discount) / 2 END AS score_A,
    CASE WHEN pred = 'N' THEN 0.5 + l_discount ELSE (0.5 - l_discount) / 2 END AS score_N,
    CASE WHEN pred = 'R' THEN 0.5 + l_discount ELSE (0.5 - l_discount) / 2 END AS score_R
  FROM pred_multi0)"""


def points_2d(t: Tables) -> DataFrame:
    c = t.customer
    return c.select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"),
                    F.col("c_nationkey").cast("double").alias("y"),
                    F.col("c_mktsegment").alias("cluster"))


POINTS_2D = """points_2d AS (
  SELECT c_custkey, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment AS cluster
  FROM customer)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
