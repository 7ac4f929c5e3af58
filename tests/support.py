"""Comparison of a Spark result with DuckDB's, without regard to order."""

from __future__ import annotations

import glob
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path + "/*.parquet" if glob.glob(path + "/*.parquet") else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def differences(df, con, sql: str) -> list:
    """Empty if both have the same columns and rows."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    if sorted(theirs) != names:
        return [("columns", names, sorted(theirs))]
    place = [theirs.index(n) for n in names]
    b = Counter(tuple(plain(r[i]) for i in place) for r in cursor.fetchall())
    a = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    return [("only ours", r) for r in list((a - b))[:3]] + [("only theirs", r) for r in list((b - a))[:3]]
