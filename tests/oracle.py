"""Compares queries with their DuckDB SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(v[i]) for i in order) for v in values)


def differences(df, con, sql: str) -> str:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.sql(sql)
    names, want = want.columns, rows(want.columns, want.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if got != want:
        odd = next((i for i, (a, b) in enumerate(zip(got, want, strict=False)) if a != b), min(len(got), len(want)))
        return f"{len(got)} and {len(want)} rows, first difference {got[odd : odd + 1]} and {want[odd : odd + 1]}"
    return ""
