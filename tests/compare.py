"""Order-free comparison of a frame with SQL over the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((value is not None, str(type(value)), value) if value is not None else (False, "", "")
                 for value in row)


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    picked = [tuple(None if isinstance(row[i], float) and math.isnan(row[i]) else row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=_key)
