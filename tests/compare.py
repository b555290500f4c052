"""Runs queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, datetime.date):
        return pd.Timestamp(x).as_unit("us")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    return x


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=repr)


def kinds_of(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def _alike(a: str, b: str) -> bool:
    return a[:8] == b[:8] == "datetime" or {a, b} <= {"object", "str"} or {a[:8], b[:8]} == {"object", "datetime"}


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows and kinds of columns."""
    ours = query(spark, sf_dir)
    mine, theirs = ours.toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0][0]} and {bad[0][1]}"
    kind = [(c, k, kinds_of(theirs)[c]) for c, k in kinds_of(mine).items() if k != kinds_of(theirs)[c] and len(mine) and mine[c].notna().all() and not _alike(k, kinds_of(theirs)[c])]
    return f"kinds {kind}" if kind else ""
