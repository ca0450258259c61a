"""Holds queries against their SQL in DuckDB, row by row."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def difference(spark_df, connection, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result, or None."""
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda row: [(x is None, str(type(x)), x if x is not None else 0) for x in row]
    wanted = sorted(([plain(row[names.index(c)]) for c in order] for row in result.fetchall()), key=key)
    found = sorted(([plain(row[c]) for c in order] for row in spark_df.collect()), key=key)
    if len(wanted) != len(found):
        return f"{len(found)} rows, wanted {len(wanted)}"
    for a, b in zip(found, wanted, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(order, a, strict=True))}, wanted {dict(zip(order, b, strict=True))}"
    return None
