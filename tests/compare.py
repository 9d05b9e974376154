"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat(" ") if isinstance(v, datetime.datetime) else v.isoformat()
    return v


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(df, con, sql: str) -> None:
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    left, right = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert len(left) == len(right)
    assert left == right
