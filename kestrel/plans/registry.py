"""Query registry shared by ``__spark_entry__``, tests and the bench."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (+ oracle SQL)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _round(c, dt, digits):
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.round(c, digits)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _round(x, dt.elementType, digits))
    return c


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, also inside arrays (the oracle SQL rounds the same way)."""
    return df.select(*[_round(F.col(f.name), f.dataType, digits).alias(f.name) for f in df.schema.fields])


def load_all():
    """Import every catalog module so that its queries register."""
    from . import catalog_profile, catalog_clean, catalog_timeseries  # noqa: F401
    from . import catalog_features, catalog_metrics, catalog_ml  # noqa: F401
    from . import catalog_sources  # noqa: F401
    return QUERIES, ORACLE
