"""Compare a Spark result with DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

from kestrel.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def compare(sdf, con, sql: str, digits: int = 5):
    """Return (ok, message). Columns compared by name, rows as multisets."""
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    scols = sdf.columns
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}"
    srows = sdf.collect()
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    S = sorted((tuple(_norm(r[i], digits) for i in si) for r in srows), key=_key)
    D = sorted((tuple(_norm(r[i], digits) for i in di) for r in drows), key=_key)
    bad = [(a, b) for a, b in zip(S, D) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{len(S)} rows"


def dtypes(sdf, con, sql):
    rel = con.sql(sql)
    return dict(sdf.dtypes), dict(zip(rel.columns, [str(t) for t in rel.types]))
