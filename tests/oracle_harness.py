"""Run a catalog query in Spark and its oracle SQL in DuckDB; compare.

Mirrors the driver's check: row count, column names, order-insensitive
values (floats rounded).
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from sitesift.sources.archive import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return int(r) if r == int(r) and abs(r) < 2**53 else r
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, (str, bytes))):
        return tuple(_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return cols, sorted(out, key=repr)


def compare(spark_df, con, sql: str):
    s_cols, s_rows = rows_of(spark_df.toPandas())
    d_cols, d_rows = rows_of(con.sql(sql).df())
    return {
        "cols_match": s_cols == d_cols,
        "spark_cols": s_cols,
        "duck_cols": d_cols,
        "rows": (len(s_rows), len(d_rows)),
        "values_match": s_rows == d_rows,
        "first_diff": next(((a, b) for a, b in zip(s_rows, d_rows) if a != b), None),
    }
