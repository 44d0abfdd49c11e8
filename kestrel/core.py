"""Shared helpers: time configuration, column roles, one-row statistics.

Fitted statistics (means, quantiles, min/max, ...) are computed by ONE
aggregation over the data and come back as a single small row; transforms
then use them as literals inside a projection, which keeps the transform
inside whole-stage codegen and needs no join at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Largest number of levels a wide output (one-hot, pivot) may produce.
MAX_LEVELS = 1000


@dataclass(frozen=True)
class TimeConfig:
    """Which column carries time, and in which zone local bins are cut."""
    time_col: str = "ts"
    timezone: str = "UTC"
    use_as_index: bool = False


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]



def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC_TYPES)


def stats_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Evaluate aggregate expressions in one pass; return them as a dict.

    The result is one row of scalars (bounded by the number of expressions),
    so bringing it to the driver is safe at any data size.
    """
    if not exprs:
        return {}
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first()
    return row.asDict() if row is not None else {k: None for k in exprs}


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """Normalise NaN to NULL in floating columns (Spark treats NaN as a value)."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.select(*[
        F.when(F.isnan(F.col(c)), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def unpivot_numeric(df: DataFrame, cols, keep=(), name="column", value="value") -> DataFrame:
    """Long form (keep..., column, value as double) of the chosen columns."""
    ids = [F.col(k) for k in keep]
    return df.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols
    ])).alias("_kv")).select(*keep, f"_kv.{name}", f"_kv.{value}")
