"""Registered queries (see registry.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, rounded
from .fixtures import tables
from ..functions import scalar as sc
from ..operators import clean as cl
from . import fixtures as fx
from .fixtures import with_ctes

EV = "event_id, ts, user_id, event_type, value, props"


@query("drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
       "l_extendedprice, l_discount, l_returnflag, l_linestatus FROM lineitem")
def q_drop_columns(spark, sf_dir):
    """lineitem without l_tax and l_shipdate."""
    return sc.drop_columns(tables(spark, sf_dir).lineitem, ["l_tax", "l_shipdate"])


@query("drop_null_rows", with_ctes(fx.EVENTS_NULLS) + f"SELECT {EV} FROM events_nulls WHERE value IS NOT NULL")
def q_drop_null_rows(spark, sf_dir):
    """events_nulls without the rows whose value is NULL."""
    return sc.drop_null_rows(fx.events_nulls(tables(spark, sf_dir)), ["value"])


@query("time_range", f"SELECT {EV} FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def q_time_range(spark, sf_dir):
    """Events from 2024-01-05 to 2024-01-10, end day inclusive."""
    return sc.time_range(tables(spark, sf_dir).events, "ts", "2024-01-05", "2024-01-10")


@query("threshold_label", with_ctes(fx.TEXT_NUMBERS) + """
SELECT event_id, ts, event_type, value_text,
       CAST(coalesce(TRY_CAST(value_text AS DOUBLE) >= 35.0, false) AS INTEGER) AS etiqueta_binaria
FROM text_numbers""")
def q_threshold_label(spark, sf_dir):
    """0/1 label value_text >= 35 over text with 'n/a' entries (not a number -> 0)."""
    return sc.threshold_label(fx.text_numbers(tables(spark, sf_dir)), "value_text", ">=", 35)


@query("between_label", with_ctes(fx.TEXT_NUMBERS) + """
SELECT event_id, ts, event_type, value_text,
       1 - CAST(coalesce(TRY_CAST(value_text AS DOUBLE) BETWEEN 20.0 AND 50.0, false) AS INTEGER) AS etiqueta_binaria
FROM text_numbers""")
def q_between_label(spark, sf_dir):
    """Inverted label for 20 <= value <= 50, bounds given swapped (50, 20)."""
    return sc.between_label(fx.text_numbers(tables(spark, sf_dir)), "value_text", 50, 20, invert=True)


@query("label_rate", with_ctes(fx.TEXT_NUMBERS) + """
SELECT CAST(sum(l) AS BIGINT) AS positives, count(l) AS total, round(100.0 * avg(l), 6) AS pct
FROM (SELECT CAST(coalesce(TRY_CAST(value_text AS DOUBLE) >= 35.0, false) AS INTEGER) AS l FROM text_numbers)""")
def q_label_rate(spark, sf_dir):
    """Positives, total and percent of the threshold label."""
    lab = sc.threshold_label(fx.text_numbers(tables(spark, sf_dir)), "value_text", ">=", 35)
    return rounded(sc.label_rate(lab, "etiqueta_binaria"))


@query("to_numeric", with_ctes(fx.TEXT_NUMBERS) +
       "SELECT event_id, ts, event_type, TRY_CAST(value_text AS DOUBLE) AS value_text FROM text_numbers")
def q_to_numeric(spark, sf_dir):
    """Text numbers to double; 'n/a' -> NULL."""
    return sc.to_numeric(fx.text_numbers(tables(spark, sf_dir)), ["value_text"])


@query("to_text", f"SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value, props FROM events")
def q_to_text(spark, sf_dir):
    """user_id as text."""
    return sc.to_text(tables(spark, sf_dir).events, ["user_id"])


@query("to_datetime", with_ctes(fx.TEXT_DATES) +
       "SELECT event_id, value, TRY_STRPTIME(ts_text, '%Y-%m-%dT%H:%M:%S') AS ts_text FROM text_dates")
def q_to_datetime(spark, sf_dir):
    """ISO text to timestamp; 'bad' -> NULL."""
    return sc.to_datetime(fx.text_dates(tables(spark, sf_dir)), ["ts_text"])


@query("calendar_parts", f"""SELECT {EV}, CAST(month(ts) AS INTEGER) AS month,
       CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour FROM events""")
def q_calendar_parts(spark, sf_dir):
    """Month, weekday (Monday=0) and hour of every event."""
    return sc.calendar_parts(tables(spark, sf_dir).events, "ts")


@query("time_index", with_ctes(fx.TEXT_DATES) + """
SELECT event_id, value,
       CAST(timezone('Europe/Madrid', timezone('UTC', TRY_STRPTIME(ts_text, '%Y-%m-%dT%H:%M:%S'))) AS TIMESTAMP) AS ts_text
FROM text_dates""")
def q_time_index(spark, sf_dir):
    """Text times read as UTC and shown in Europe/Madrid wall-clock time."""
    from ..core import TimeConfig
    out, stats = sc.time_index(fx.text_dates(tables(spark, sf_dir)), TimeConfig("ts_text", "Europe/Madrid"))
    return out


@query("impute_mean", with_ctes(fx.EVENTS_NULLS) + """
SELECT event_id, ts, user_id, event_type,
       round(coalesce(value, (SELECT avg(value) FROM events_nulls)), 6) AS value, props FROM events_nulls""")
def q_impute_mean(spark, sf_dir):
    """NULL values of events_nulls filled with the mean."""
    return rounded(cl.impute_mean(fx.events_nulls(tables(spark, sf_dir))))


@query("impute_median", with_ctes(fx.EVENTS_NULLS) + """
SELECT event_id, ts, user_id, event_type,
       round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_nulls)), 6) AS value, props
FROM events_nulls""")
def q_impute_median(spark, sf_dir):
    """NULL values of events_nulls filled with the exact median."""
    return rounded(cl.impute_median(fx.events_nulls(tables(spark, sf_dir))))


@query("dedup", with_ctes(fx.EVENTS_DUPS) + f"SELECT DISTINCT {EV} FROM events_dups")
def q_dedup(spark, sf_dir):
    """events plus copies, repeated rows dropped."""
    return cl.dedup(fx.events_dups(tables(spark, sf_dir)))


@query("dedup_by_key", f"""SELECT {EV} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def q_dedup_by_key(spark, sf_dir):
    """First event (by ts) of every user."""
    return cl.dedup(tables(spark, sf_dir).events, ["user_id"], order_by=["ts", "event_id"])


@query("label_encode", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
       CAST(dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS INTEGER) AS c_mktsegment
FROM customer""")
def q_label_encode(spark, sf_dir):
    """Market segment as the rank of its text among the sorted segments."""
    return cl.label_encode(tables(spark, sf_dir).customer, ["c_mktsegment"])


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _onehot_sql(levels):
    return ("SELECT c_custkey, c_name, c_nationkey, c_acctbal, " + ", ".join(
        f"CAST(coalesce(c_mktsegment = '{v}', false) AS INTEGER) AS c_mktsegment_{v}" for v in levels)
        + " FROM customer")


@query("one_hot", _onehot_sql(_SEG))
def q_one_hot(spark, sf_dir):
    """Market segment as 0/1 columns, one per segment."""
    return cl.one_hot(tables(spark, sf_dir).customer, ["c_mktsegment"])


@query("one_hot_drop_first", _onehot_sql(_SEG[1:]))
def q_one_hot_drop_first(spark, sf_dir):
    """Market segment dummies without the first level."""
    return cl.one_hot_drop_first(tables(spark, sf_dir).customer, ["c_mktsegment"])


_SC = ["l_quantity", "l_extendedprice", "const_col"]
_LI_REST = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _scale_sql(expr):
    stats = ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS sd_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}, "
        f"quantile_cont({c}, 0.5) AS md_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}"
        for c in _SC)
    cols = ", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in _SC)
    return (with_ctes(fx.LINEITEM_CONST) + f", s AS (SELECT {stats} FROM lineitem_const)\n"
            f"SELECT {_LI_REST}, {cols} FROM lineitem_const, s")


@query("scale_standard", _scale_sql("({c} - m_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END"))
def q_scale_standard(spark, sf_dir):
    """Standard scaling (population std) of two lineitem columns and a constant one."""
    return rounded(cl.scale_standard(fx.lineitem_const(tables(spark, sf_dir)), _SC))


@query("scale_minmax", _scale_sql("({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END"))
def q_scale_minmax(spark, sf_dir):
    """Min-max scaling to [0, 1]; the constant column becomes 0."""
    return rounded(cl.scale_minmax(fx.lineitem_const(tables(spark, sf_dir)), _SC))


@query("scale_minmax_inverse", _scale_sql("{c}"))
def q_scale_minmax_inverse(spark, sf_dir):
    """Min-max scaling followed by its inverse gives the original values."""
    df = fx.lineitem_const(tables(spark, sf_dir))
    p = cl.fit_minmax(df, _SC)
    return rounded(cl.scale_minmax_inverse(cl.scale_minmax(df, _SC, params=p), p))


@query("scale_robust", _scale_sql("({c} - md_{c}) / CASE WHEN iqr_{c} = 0 THEN 1 ELSE iqr_{c} END"))
def q_scale_robust(spark, sf_dir):
    """Robust scaling with exact median and IQR."""
    return rounded(cl.scale_robust(fx.lineitem_const(tables(spark, sf_dir)), _SC))


_OUT_COLS = ["value", "user_id"]
_IQR_FLAG = """, q AS (SELECT quantile_cont(value, 0.25) AS q1v, quantile_cont(value, 0.75) AS q3v,
                  quantile_cont(user_id, 0.25) AS q1u, quantile_cont(user_id, 0.75) AS q3u,
                  avg(value) AS mv, avg(user_id) AS mu,
                  quantile_cont(value, 0.5) AS dv, quantile_cont(user_id, 0.5) AS du FROM events),
f AS (SELECT e.*, coalesce(value < q1v - 1.5 * (q3v - q1v) OR value > q3v + 1.5 * (q3v - q1v), false)
              OR coalesce(user_id < q1u - 1.5 * (q3u - q1u) OR user_id > q3u + 1.5 * (q3u - q1u), false) AS is_outlier,
              mv, mu, dv, du
      FROM events e, q)
"""
_Z_FLAG = """, z AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events),
f AS (SELECT e.*, coalesce(abs((value - m) / s) > 3.0, false) AS is_outlier FROM events e, z)
"""


@query("outliers_iqr", "WITH x AS (SELECT 1)" + _IQR_FLAG + f"SELECT {EV}, is_outlier FROM f")
def q_outliers_iqr(spark, sf_dir):
    """IQR outlier flag over value and user_id (a row is out if any column is)."""
    return cl.outliers_iqr(tables(spark, sf_dir).events, _OUT_COLS)


@query("outliers_zscore", "WITH x AS (SELECT 1)" + _Z_FLAG + f"SELECT {EV}, is_outlier FROM f")
def q_outliers_zscore(spark, sf_dir):
    """z-score (sample std) outlier flag of value, threshold 3."""
    return cl.outliers_zscore(tables(spark, sf_dir).events, ["value"], 3.0)


@query("outliers_remove", "WITH x AS (SELECT 1)" + _IQR_FLAG + f"SELECT {EV} FROM f WHERE NOT is_outlier")
def q_outliers_remove(spark, sf_dir):
    """Events without IQR outliers."""
    return cl.outliers_remove(tables(spark, sf_dir).events, _OUT_COLS, "iqr")


@query("outliers_replace_mean", "WITH x AS (SELECT 1)" + _IQR_FLAG + """
SELECT event_id, ts, event_type, props,
       round(CASE WHEN is_outlier THEN mv ELSE value END, 6) AS value,
       round(CASE WHEN is_outlier THEN mu ELSE user_id END, 6) AS user_id FROM f""")
def q_outliers_replace_mean(spark, sf_dir):
    """In flagged rows both chosen columns take their means."""
    return rounded(cl.outliers_replace_mean(tables(spark, sf_dir).events, _OUT_COLS, "iqr"))


@query("outliers_replace_median", "WITH x AS (SELECT 1)" + _IQR_FLAG + """
SELECT event_id, ts, event_type, props,
       round(CASE WHEN is_outlier THEN dv ELSE value END, 6) AS value,
       round(CASE WHEN is_outlier THEN du ELSE user_id END, 6) AS user_id FROM f""")
def q_outliers_replace_median(spark, sf_dir):
    """In flagged rows both chosen columns take their exact medians."""
    return rounded(cl.outliers_replace_median(tables(spark, sf_dir).events, _OUT_COLS, "iqr"))


@query("outliers_mark", "WITH x AS (SELECT 1)" + _IQR_FLAG + f"""
SELECT {EV}, CAST(is_outlier AS INTEGER) AS value_is_outlier, CAST(is_outlier AS INTEGER) AS user_id_is_outlier FROM f""")
def q_outliers_mark(spark, sf_dir):
    """Outlier flag as 0/1 columns {col}_is_outlier."""
    return cl.outliers_mark(tables(spark, sf_dir).events, _OUT_COLS, "iqr")
