"""Runs a query and its DuckDB SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def same_rows(spark, con, query, sql: str, folder: str) -> int:
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert names == sorted(columns)
    want = sorted(repr([plain(r[columns.index(n)]) for n in names]) for r in cursor.fetchall())
    assert got == want
    return len(got)
