"""Compares a query's rows with DuckDB's on the same tables: columns by name, rows in any order, values exactly."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        return v.date()
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql: str, con) -> str:
    """Empty when both give the same rows."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    one, two = rows(df.columns, df.collect()), rows(names, result.fetchall())
    if len(one) != len(two):
        return f"{len(one)} and {len(two)} rows"
    bad = [(a, b) for a, b in zip(one, two, strict=True) if a != b]
    return f"{len(bad)} of {len(one)} rows differ, such as {bad[0]}" if bad else ""
