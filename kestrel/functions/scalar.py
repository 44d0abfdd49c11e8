"""Column-level operators: labels, type conversion, calendar parts, time filters.

All are projections built from Spark SQL functions (no Python per row).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import TIME_TYPES, TimeConfig

# Fixed values of the reference: the default label name and the comparison
# operators offered for a threshold label.
DEFAULT_LABEL = "etiqueta_binaria"
OPERATORS = (">=", ">", "<=", "<", "==", "between")


def as_number(c: Column) -> Column:
    """Text or number -> double; text that is not a number -> NULL (ANSI-safe)."""
    return c.try_cast("double")


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or, if taken, ``name_2``, ``name_3``, ..."""
    if name not in df.columns:
        return name
    k = 2
    while f"{name}_{k}" in df.columns:
        k += 1
    return f"{name}_{k}"


def threshold_label(df: DataFrame, col: str, op: str, thr=None, thr_min=None, thr_max=None,
                    name: str = DEFAULT_LABEL, invert: bool = False) -> DataFrame:
    """Append a 0/1 label; values that are not numbers count as false.

    ``between`` is inclusive and swaps the bounds when min > max. ``invert``
    gives 1 - label, so rows whose value is not a number become 1.
    """
    s = as_number(F.col(col))
    if op == "between":
        if thr_min is None or thr_max is None:
            raise ValueError("between needs thr_min and thr_max")
        lo, hi = (thr_min, thr_max) if thr_min <= thr_max else (thr_max, thr_min)
        cond = s.between(F.lit(float(lo)), F.lit(float(hi)))
    elif op in (">=", ">", "<=", "<", "=="):
        if thr is None:
            raise ValueError("threshold needed")
        t = F.lit(float(thr))
        cond = {">=": s >= t, ">": s > t, "<=": s <= t, "<": s < t, "==": s == t}[op]
    else:
        raise ValueError(f"unknown operator {op!r}")
    lab = F.coalesce(cond, F.lit(False)).cast("int")
    if invert:
        lab = (F.lit(1) - lab).cast("int")
    return df.withColumn(free_name(df, (name or DEFAULT_LABEL).strip()), lab)


def between_label(df: DataFrame, col: str, thr_min, thr_max, name: str = DEFAULT_LABEL,
                  invert: bool = False) -> DataFrame:
    return threshold_label(df, col, "between", thr_min=thr_min, thr_max=thr_max, name=name, invert=invert)


def label_rate(df: DataFrame, label: str) -> DataFrame:
    """(positives, total, pct) of a 0/1 column."""
    return df.agg(F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("positives"),
                  F.count(label).alias("total"),
                  (100.0 * F.avg(F.col(label).cast("double"))).alias("pct"))


def to_numeric(df: DataFrame, cols) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*[as_number(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def to_text(df: DataFrame, cols) -> DataFrame:
    """String form; NULL stays NULL."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


# Formats tried in order when text is turned into a time (ISO forms first).
DATETIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
                    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
                    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")


# Formats that carry a zone (Z or an offset); their instants are expressed in UTC.
ZONED_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
                 "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX")


def parse_datetime(c: Column, formats=DATETIME_FORMATS) -> Column:
    """Text -> timestamp_ntz; unparseable -> NULL. A text with a zone gives its UTC time."""
    plain = [F.try_to_timestamp(c.cast("string"), F.lit(f)).cast("timestamp_ntz") for f in formats]
    zoned = [F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(
        c.cast("string"), F.lit(f)).cast("timestamp_ntz")) for f in ZONED_FORMATS]
    return F.coalesce(*plain, *zoned)


def as_datetime(df: DataFrame, c: str, formats=DATETIME_FORMATS) -> Column:
    """A column as timestamp_ntz: real times are converted as they are, text is parsed."""
    if isinstance(df.schema[c].dataType, TIME_TYPES):
        return F.col(c).cast("timestamp_ntz")
    return parse_datetime(F.col(c), formats)


def to_datetime(df: DataFrame, cols, formats=DATETIME_FORMATS) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*[as_datetime(df, c, formats).alias(c) if c in cols else F.col(c) for c in df.columns])


def calendar_parts(df: DataFrame, time_col: str, timezone: str = "UTC") -> DataFrame:
    """month 1-12, weekday Monday=0, hour 0-23 in the wall clock of ``timezone``."""
    from ..operators.resample import local_time
    t = local_time(F.col(time_col), timezone)
    return df.withColumns({"month": F.month(t), "weekday": F.weekday(t), "hour": F.hour(t)})


def time_index(df: DataFrame, cfg: TimeConfig):
    """Parse ``cfg.time_col`` as a UTC instant, express it in ``cfg.timezone``.

    Returns (DataFrame, stats) where stats is a one-row DataFrame with
    (n_rows, n_unparseable). Raises ValueError when no value parses. The
    frame is not globally sorted: ordering is a property of later operators.
    """
    from ..operators.resample import local_time
    parsed = as_datetime(df, cfg.time_col)
    out = df.withColumn(cfg.time_col, local_time(parsed, cfg.timezone))
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_if(parsed.isNull()).alias("n_unparseable"))
    return out, stats


def check_time_index(stats_df: DataFrame) -> dict:
    r = stats_df.first().asDict()
    if r["n_rows"] and r["n_unparseable"] == r["n_rows"]:
        raise ValueError("no value of the time column could be read as a date-time")
    return r


def time_range(df: DataFrame, time_col: str, start=None, end=None) -> DataFrame:
    """Keep start <= t <= end, the end day inclusive. Only when both are given."""
    if start is None or end is None:
        return df
    s = _as_dt(start)
    e = _as_dt(end)
    typ = df.schema[time_col].dataType

    def lit(v):
        return F.lit(v.isoformat(sep=" ")).cast(typ)
    day_end = (isinstance(end, str) and len(end) <= 10) or (
        isinstance(end, _dt.date) and not isinstance(end, _dt.datetime))
    if day_end:
        return df.where((F.col(time_col) >= lit(s)) & (F.col(time_col) < lit(e + _dt.timedelta(days=1))))
    return df.where((F.col(time_col) >= lit(s)) & (F.col(time_col) <= lit(e)))


def _as_dt(v):
    if isinstance(v, _dt.datetime):
        return v
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day)
    return _dt.datetime.fromisoformat(str(v))


def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*([cols] if isinstance(cols, str) else cols))


def drop_null_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows with NULL in any listed column (all columns by default)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)
