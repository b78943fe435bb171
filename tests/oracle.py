"""Compares a query with its DuckDB SQL on the same Parquet tables."""

from __future__ import annotations

import os
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return ""
    if isinstance(v, (float, Decimal)):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return str(v)


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
