"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((v is not None, "" if v is None else (f"{v:+025.3f}" if isinstance(v, float) else str(v))) for v in row)


def _same(a, b, tol):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def _kind(v):
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def compare(spark_df, con, sql, tol=1e-6):
    """Empty string when equal, otherwise a description of the first difference."""
    cols = sorted(spark_df.columns)
    left = [tuple(_norm(r[c]) for c in cols) for r in spark_df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    if len(left) != len(right):
        return f"row count {len(left)} vs {len(right)}"
    left.sort(key=_key), right.sort(key=_key)
    typed = ""
    strict = 0
    for a, b in zip(left, right):
        for c, x, y in zip(cols, a, b):
            if not _same(x, y, tol):
                return f"value differs in {c}: {x!r} vs {y!r}\n  {a}\n  {b}"
            if x is not None and y is not None and type(x) is not type(y) and not typed:
                typed = f"[types differ in {c}: {type(x).__name__} vs {type(y).__name__}]"
            if isinstance(x, float) and isinstance(y, float) and round(x, 4) != round(y, 4):
                strict += 1
    return (typed + (f"[{strict} floats differ at 4 digits]" if strict else "")) if (typed or strict) else ""
