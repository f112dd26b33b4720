"""A registered query against its DuckDB form."""

from __future__ import annotations

import os

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(spark, queries, oracle, name: str, sf_dir: str) -> str | None:
    frame = queries[name](spark, sf_dir)
    cursor = duck(sf_dir).execute(oracle[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {frame.columns} against {columns}"
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    if len(got) != len(want) or not got:
        return f"{len(got)} rows against {len(want)}"
    return next((f"{a} against {b}" for a, b in zip(got, want, strict=True) if a != b or [type(x) for x in a] != [type(x) for x in b]), None)
