"""Registered time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as rs
from .fixtures import tables
from .registry import query, rounded


@query("resample_agg", """
WITH b AS (
  SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts,
         CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value
  FROM events),
a AS (
  SELECT event_type, ts,
         avg(event_id) AS event_id_mean, max(event_id) AS event_id_max,
         avg(user_id) AS user_id_mean, max(user_id) AS user_id_max,
         avg(value) AS value_mean, max(value) AS value_max
  FROM b GROUP BY 1, 2),
r AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM a GROUP BY 1),
s AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS ts FROM r)
SELECT s.event_type, s.ts,
       round(event_id_mean, 6) AS event_id_mean, round(event_id_max, 6) AS event_id_max,
       round(user_id_mean, 6) AS user_id_mean, round(user_id_max, 6) AS user_id_max,
       round(value_mean, 6) AS value_mean, round(value_max, 6) AS value_max
FROM s LEFT JOIN a USING (event_type, ts)
""")
def q_resample_agg(spark, sf_dir):
    """Hourly mean and max of every numeric column of events, per event type."""
    e = tables(spark, sf_dir).events
    return rounded(rs.resample_agg(e, "ts", "1H", ("mean", "max"), group_col="event_type"))

from ..operators import timeseries as ts
from . import fixtures as fx
from .fixtures import with_ctes

EV = "event_id, ts, user_id, event_type, value, props"
TYPES = ["click", "error", "purchase", "signup", "view"]


@query("resample_mean", """
WITH a AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
r AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM a GROUP BY 1),
s AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS ts FROM r)
SELECT s.event_type, s.ts, round(a.value, 6) AS value FROM s LEFT JOIN a USING (event_type, ts)""")
def q_resample_mean(spark, sf_dir):
    """Hourly mean value per event type; empty hours present as NULL."""
    return rounded(ts.resample_mean(tables(spark, sf_dir).events, "ts", "value", "1H", ["event_type"]))


@query("interpolate_linear", """
WITH a AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
r AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM a GROUP BY 1),
s AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS ts FROM r),
g AS (SELECT s.event_type, s.ts, a.value, row_number() OVER (PARTITION BY s.event_type ORDER BY s.ts) AS pos
      FROM s LEFT JOIN a USING (event_type, ts)),
n AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
  last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,
  first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM g)
SELECT event_type, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN pp IS NULL THEN NULL
  WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END, 6) AS value FROM n""")
def q_interpolate(spark, sf_dir):
    """Hourly mean per event type with empty hours filled linearly."""
    r = ts.resample_mean(tables(spark, sf_dir).events, "ts", "value", "1H", ["event_type"])
    return rounded(ts.interpolate_linear(r, "ts", "value", ["event_type"]))


def _hourly_wide(spark, sf_dir):
    e = tables(spark, sf_dir).events
    return (e.groupBy(ts.bin_start(F.col("ts"), "1H").alias("ts"))
            .pivot("event_type", TYPES).agg(F.avg("value")))


HOURLY_WIDE = """hourly_wide AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS ts,
  """ + ",\n  ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + """
  FROM events GROUP BY 1)"""


@query("align_series", with_ctes(HOURLY_WIDE) + """
SELECT time_bucket(INTERVAL '6 hours', ts) AS ts, round(avg(click), 6) AS a, round(avg("view"), 6) AS b
FROM hourly_wide GROUP BY 1 HAVING avg(click) IS NOT NULL AND avg("view") IS NOT NULL""")
def q_align(spark, sf_dir):
    """Hourly click and view means resampled to 6 h and aligned (both present)."""
    return rounded(ts.align_series(_hourly_wide(spark, sf_dir), "ts", "click", "view", "6H"))


_ALIGNED = with_ctes(HOURLY_WIDE) + """, al AS (SELECT ts, click AS a, "view" AS b FROM hourly_wide
  WHERE click IS NOT NULL AND "view" IS NOT NULL)
"""


@query("corr_pearson", _ALIGNED + "SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM al")
def q_corr_pearson(spark, sf_dir):
    """Pearson r of hourly click and view means (p-value checked in tests)."""
    al = ts.align_series(_hourly_wide(spark, sf_dir), "ts", "click", "view")
    return rounded(ts.corr_pearson(al).select("r", "n"))


@query("corr_spearman", _ALIGNED + """, rk AS (SELECT
  rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM al)
SELECT round(corr(ra, rb), 6) AS r, count(*) AS n FROM rk""")
def q_corr_spearman(spark, sf_dir):
    """Spearman r (average ranks) of hourly click and view means."""
    al = ts.align_series(_hourly_wide(spark, sf_dir), "ts", "click", "view")
    return rounded(ts.corr_spearman(al).select("r", "n"))


@query("rolling_mean", with_ctes(fx.EVENTS_NULLS) + f"""
SELECT {EV}, round(CASE WHEN count(*) OVER w = 24 THEN avg(value) OVER w END, 6) AS rolling_mean
FROM events_nulls WHERE value IS NOT NULL
WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean(spark, sf_dir):
    """Trailing 24-point mean over all non-null events (one series, by time)."""
    return rounded(ts.rolling_mean(fx.events_nulls(tables(spark, sf_dir)), "ts", "value", 24))


_HOURLY_POS = with_ctes(fx.HOURLY) + """, hp AS (SELECT ts, value, n, row_number() OVER (ORDER BY ts) - 1 AS pos,
  count(*) OVER () AS len, avg(value) OVER () AS m FROM hourly)
"""


@query("acf", _HOURLY_POS + """, lg AS (SELECT unnest(generate_series(0, 48)) AS lag)
SELECT CAST(lg.lag AS INTEGER) AS lag, round(
  (SELECT sum((x.value - x.m) * (y.value - y.m)) FROM hp x JOIN hp y ON y.pos = x.pos + lg.lag) /
  (SELECT sum((value - m) * (value - m)) FROM hp), 6) AS acf FROM lg""")
def q_acf(spark, sf_dir):
    """Autocorrelation of the hourly mean value, lags 0..48."""
    return rounded(ts.acf(fx.hourly(tables(spark, sf_dir)), "ts", "value", 48))


@query("box_stats", f"""
WITH d AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, value FROM events WHERE value IS NOT NULL),
q AS (SELECT hour, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM d GROUP BY 1)
SELECT d.hour, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) AS n,
  count(*) FILTER (WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM d JOIN q USING (hour) GROUP BY d.hour""")
def q_box_stats(spark, sf_dir):
    """Box-plot statistics of value per hour of day."""
    from ..functions.scalar import calendar_parts
    e = calendar_parts(tables(spark, sf_dir).events, "ts")
    return rounded(ts.box_stats(e, "value", "hour"))


@query("heatmap_weekday_hour", """
WITH c AS (SELECT CAST(w AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour
           FROM generate_series(0, 6) t(w), generate_series(0, 23) u(h)),
a AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, avg(value) AS mean
      FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT c.weekday, c.hour, round(a.mean, 6) AS mean FROM c LEFT JOIN a USING (weekday, hour)""")
def q_heatmap(spark, sf_dir):
    """Mean value by weekday x hour, all 168 cells."""
    return rounded(ts.heatmap_weekday_hour(tables(spark, sf_dir).events, "ts", "value"))


@query("lag_features", _HOURLY_POS + """
SELECT ts, lag_1, lag_2, lag_3, lag_4, lag_5, n, y FROM (
  SELECT ts, pos, len, n, round(value, 6) AS y,
    round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 2) OVER w, 6) AS lag_2,
    round(lag(value, 3) OVER w, 6) AS lag_3, round(lag(value, 4) OVER w, 6) AS lag_4,
    round(lag(value, 5) OVER w, 6) AS lag_5
  FROM hp WINDOW w AS (ORDER BY pos)) WHERE pos >= 5 AND pos < len - 10""")
def q_lag_features(spark, sf_dir):
    """5 lags of the hourly mean + exogenous count -> value; last 10 held back."""
    return rounded(ts.lag_features(fx.hourly(tables(spark, sf_dir)), "ts", "value", 5, 10, exog=["n"]))


@query("sequence_windows", _HOURLY_POS + """
SELECT ts, seq, label FROM (
  SELECT ts, pos, CAST(value > 35 AS INTEGER) AS label,
    list([round(value, 6), round(CAST(n AS DOUBLE), 6)]) OVER (ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS seq
  FROM hp) WHERE pos >= 14""")
def q_sequence_windows(spark, sf_dir):
    """14 past hours of (mean, count) -> label value > 35 at the hour."""
    from ..functions.scalar import threshold_label
    h = threshold_label(fx.hourly(tables(spark, sf_dir)), "value", ">", 35, name="label_gt35")
    return rounded(ts.sequence_windows(h, "ts", ["value", "n"], "label_gt35", 14))


@query("multi_horizon_dataset", _HOURLY_POS + """, sc AS (SELECT *, (value - min(value) OVER ()) /
    (max(value) OVER () - min(value) OVER ()) AS v FROM hp)
SELECT i, x, y FROM (
  SELECT pos AS i, len,
    list(round(v, 6)) OVER (ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x,
    list(round(v, 6)) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS y
  FROM sc) WHERE i >= 10 AND i < len - 10""")
def q_multi_horizon(spark, sf_dir):
    """Min-max scaled hourly means: 10 past values -> next 10 values."""
    out, _ = ts.multi_horizon_dataset(fx.hourly(tables(spark, sf_dir)), "ts", "value", 10, 10)
    return rounded(out)


@query("pacf")
def q_pacf(spark, sf_dir):
    """Partial autocorrelation (Yule-Walker, n - k denominators) of the hourly mean, lags 0..48."""
    return rounded(ts.pacf(fx.hourly(tables(spark, sf_dir)), "ts", "value", 48))
