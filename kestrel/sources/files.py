"""File sources and sinks: CSV, JSON (records or column-oriented), stages.

Readers are plain ``spark.read`` calls (split, parallel, pushdown where the
format allows). A column-oriented JSON document ``{col: {row: value}}`` is
one JSON value, so one task parses each file; it is then exploded into
(row, column, value) and pivoted back by row on the cluster.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import nan_to_null

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scratch_path(spark: SparkSession, name: str = "stage") -> str:
    """A new folder under the shared checkpoint folder (never machine-local)."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "kestrel-io", f"{name}-{uuid.uuid4().hex}")


def read_csv(spark: SparkSession, path: str, schema=None, sep: str = ",") -> DataFrame:
    """Header row, UTF-8, types inferred unless a schema is given; inferred
    integer columns are 64-bit, as in the reference's reader."""
    r = spark.read.option("header", True).option("encoding", "UTF-8").option("sep", sep)
    if schema is not None:
        return r.schema(schema).csv(path)
    df = r.option("inferSchema", True).csv(path)
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name)
                       if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def read_json(spark: SparkSession, path: str, orient: str = "records", schema=None) -> DataFrame:
    """``records``: JSON lines or one array of objects; ``columns``: one
    document {column: {row: value}} (the default layout of pandas)."""
    if orient == "records":
        r = spark.read.option("multiLine", _is_array_doc(spark, path))
        return (r.schema(schema) if schema is not None else r).json(path)
    if orient == "columns":
        return read_json_columns(spark, path)
    raise ValueError(f"unknown JSON orient {orient!r}")


def _is_array_doc(spark, path) -> bool:
    head = spark.read.text(path).limit(1).collect()
    return bool(head) and head[0][0].lstrip().startswith("[")


def read_json_columns(spark: SparkSession, path: str) -> DataFrame:
    """Column documents of one or several files, one after the other by file name.

    Row labels order the rows of a file: as numbers where they are numbers, else as
    texts after them. Rows are joined by (file, label), so labels that repeat in
    another file are rows of their own.
    """
    doc = spark.read.option("wholetext", True).text(path)
    m = doc.select(F.input_file_name().alias("_file"), F.from_json("value", "map<string, map<string, string>>").alias("m"))
    cells = m.select("_file", F.explode("m").alias("column", "rows")).select(
        "_file", "column", F.explode("rows").alias("_row", "value"))
    # column names in the order of their first document position; one row per column
    names = [r["column"] for r in m.select("_file", F.posexplode(F.map_keys("m")).alias("p", "column"))
             .groupBy("column").agg(F.min(F.struct("_file", "p")).alias("at")).orderBy("at").collect()]
    wide = cells.groupBy("_file", "_row").pivot("column", names).agg(F.first("value"))
    # a column becomes numeric when every non-null value reads as a number
    ok = wide.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c)
                    for c in names]).first()
    return wide.orderBy("_file", F.col("_row").try_cast("double").asc_nulls_last(), "_row").select(*[
        (F.col(f"`{c}`").try_cast("double") if ok[c] == 0 else F.col(f"`{c}`")).alias(c) for c in names])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Reader chosen by the file name (csv or json); unknown, unreadable or
    empty input raises ValueError (the reference's rules). NaN becomes NULL."""
    name = os.path.basename(path.rstrip("/")).lower()
    if "csv" in name:
        df = read_csv(spark, path)
    elif "json" in name:
        df = read_json(spark, path)
    elif "xls" in name:
        raise ValueError("workbooks are not read; export the sheet to CSV")
    else:
        raise ValueError(f"unsupported file type: {name}")
    if not df.columns or df.isEmpty():
        raise ValueError("the file holds no rows")
    return nan_to_null(df)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Persist a stage; text formats write ISO date-times."""
    w = df.write.mode(mode).format(fmt)
    if fmt in ("json", "csv"):
        w = w.option("timestampFormat", ISO_TS).option("timestampNTZFormat", ISO_TS)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("inferSchema", schema is None)
    return r.load(path)
