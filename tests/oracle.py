"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if isinstance(x, float):
            return "null" if x != x else f"{x:.9g}"
        if x is None or x is pd.NaT or x is pd.NA:
            return "null"
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int):
            return f"{float(x):.9g}"
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None))


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only in Spark {only_a}, only in SQL {only_b}"
    return ""
