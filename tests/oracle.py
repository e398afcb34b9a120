"""Runs a query on Spark and its SQL on DuckDB, and compares columns and rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            path = path + "/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        assert not math.isinf(v) and not math.isnan(v), "NaN or infinity in a result"
        return round(v, 9) + 0.0
    if v is not None and type(v).__name__ == "Decimal":
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} and {sorted(names)}")
    if len(got) != len(want):
        out.append(f"{len(got)} and {len(want)} rows")
    only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    if only_got or only_want:
        out.append(f"{len(only_got)} rows differ: {only_got[:3]} and {only_want[:3]}")
    return out
