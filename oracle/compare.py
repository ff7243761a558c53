"""Compare a Spark result with the rows of a DuckDB statement."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

# Tolerance, as rounded decimals, for doubles that both engines already rounded.
DECIMALS = 6


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """Connection with a view per parquet table of ``sf_dir``."""
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, DECIMALS)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(v is not None, str(v)) for v in row])


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """First difference between the two results in any row order, or None."""
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    expected = _normal(columns, result.fetchall())
    actual = _normal(df.columns, [tuple(row) for row in df.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows instead of {len(expected)}"
    for got, want in zip(actual, expected):
        if got != want:
            return f"{got} instead of {want}"
    return None
