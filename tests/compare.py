"""Compare a Spark query with its SQL in DuckDB on the same Parquet files."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}')")
    return con


def cell(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(cell(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in found.fetchall())


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def kinds_differ(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    theirs = dict(zip((d := con.sql(sql)).columns, map(str, d.types)))
    return [(c, t, theirs.get(c)) for c, t in df.dtypes if KINDS.get(t) != theirs.get(c)]
