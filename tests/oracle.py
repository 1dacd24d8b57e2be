"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return connection


def plain(value):
    """Values as they are compared; a NaN equals nothing, not even another one."""
    if isinstance(value, float):
        return object() if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return int(value) if isinstance(value, bool) else value


def compare(df, sql: str, connection) -> tuple[int, list, list]:
    """Rows of the query, and rows that only the query or only the SQL has."""
    names = sorted(df.columns)
    relation = connection.sql(sql)
    assert sorted(relation.columns) == names, (sorted(relation.columns), names)
    mine = Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())
    listed = ", ".join(f'"{n}"' for n in names)
    theirs = Counter(tuple(plain(v) for v in row) for row in connection.sql(f"SELECT {listed} FROM ({sql})").fetchall())
    return sum(mine.values()), list((mine - theirs).elements()), list((theirs - mine).elements())
