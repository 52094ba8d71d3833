"""Side-by-side run of a registered query and its SQL counterpart."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float) and value == int(value):
        return int(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> list[str]:
    """What the DataFrame and the SQL result do not share; empty when equal."""
    names, mine = _bag(df.columns, df.collect())
    cursor = connection.execute(sql)
    other_names, theirs = _bag([c[0] for c in cursor.description], cursor.fetchall())
    if names != other_names:
        return [f"columns {names} != {other_names}"]
    lines = [f"only spark: {row}" for row in list((mine - theirs))[:3]]
    lines += [f"only sql:   {row}" for row in list((theirs - mine))[:3]]
    return [f"{sum(mine.values())} rows vs {sum(theirs.values())}", *lines] if lines else []
