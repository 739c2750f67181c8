"""Run a query on Spark and its SQL on DuckDB over the same files, and compare all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(map(_plain, v))
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr), [columns[k] for k in order]


def compare(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """"" if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    mine, my_columns = rows_of(df.columns, df.collect())
    con = con or connect(sf_dir)
    cur = con.execute(sql)
    theirs, their_columns = rows_of([d[0] for d in cur.description], cur.fetchall())
    if my_columns != their_columns:
        return f"columns {my_columns} and {their_columns}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; first {mine[:1]} and {theirs[:1]}"
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(odd)} of {len(mine)} rows differ, first {odd[0]}" if odd else ""
