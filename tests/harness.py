"""Run a registered query in Spark and its twin in DuckDB and compare them."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in VIEWS:
        if Path(folder, f"{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _table(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


# Spark type name -> DuckDB type name
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def differences(frame, connection, sql: str) -> str | None:
    """None if equal, else what differs."""
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    expected = _table(names, relation.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in connection.execute(f"DESCRIBE {sql}").fetchall() for d in [(d[0], d[1])]}
    odd = []
    for name, kind in frame.dtypes:
        want = TYPES.get(kind, kind.upper())
        if want != types[name]:
            odd.append(f"{name}: {kind} vs {types[name]}")
    got = _table(frame.columns, [tuple(r) for r in frame.collect()])
    if got != expected:
        missing, extra = list((expected - got).items())[:2], list((got - expected).items())[:2]
        return (
            f"rows {sum(got.values())} vs {sum(expected.values())}; missing {missing}; extra {extra}; types {odd}"
        )
    return f"types {odd}" if odd else None
