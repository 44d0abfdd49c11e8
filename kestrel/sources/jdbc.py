"""Database tables over JDBC.

Tables are defined lazily (one DataFrame per chosen table, nothing read
until an action), read in parallel slices of a numeric column when one is
given, and never capped unless the caller asks for ``limit``. Listing runs
one catalog query; the schema filter is escaped, not interpolated raw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _quote_literal(v: str) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _quote_ident(v: str) -> str:
    return '"' + str(v).replace('"', '""') + '"'


def list_tables_sql(schema: str | None = None, dialect: str = "ansi") -> str:
    """Catalog query for base tables (``schema_name``, ``table_name``)."""
    if dialect == "derby":
        q = ("SELECT s.SCHEMANAME AS schema_name, t.TABLENAME AS table_name FROM SYS.SYSTABLES t "
             "JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE t.TABLETYPE = 'T'")
        return q + (f" AND s.SCHEMANAME = {_quote_literal(schema)}" if schema else "")
    q = ("SELECT table_schema AS schema_name, table_name FROM information_schema.tables "
         "WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ('pg_catalog', 'information_schema')")
    return q + (f" AND table_schema = {_quote_literal(schema)}" if schema else "")


def jdbc_list_tables(spark: SparkSession, url: str, schema: str | None = None, dialect: str = "ansi",
                     properties: dict | None = None) -> DataFrame:
    """Base tables of the database; an empty result raises ValueError."""
    r = spark.read.format("jdbc").option("url", url).option("query", list_tables_sql(schema, dialect))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    df = r.load()
    if df.isEmpty():
        raise ValueError("no tables found" + (f" in schema {schema}" if schema else ""))
    return df


def table_ref(schema: str | None, table: str) -> str:
    return f"{_quote_ident(schema)}.{_quote_ident(table)}" if schema else _quote_ident(table)


def jdbc_read_table(spark: SparkSession, url: str, table: str, schema: str | None = None,
                    partition_column: str | None = None, lower_bound=None, upper_bound=None,
                    num_partitions: int | None = None, limit: int | None = None,
                    properties: dict | None = None) -> DataFrame:
    """One table as a lazy DataFrame; parallel slices on ``partition_column``.

    Filters and column selections of later operators are pushed to the
    database by Spark's JDBC source; ``limit`` is optional (no default cap).
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table_ref(schema, table))
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    df = r.load()
    return df.limit(limit) if limit else df
