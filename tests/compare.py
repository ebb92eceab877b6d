"""Run a query in Spark and its check in DuckDB and compare all values."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

from lakeseed.sources.tables import TABLES, table_path


def check_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{table_path(folder, name)}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def compare(frame, connection, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    relation = connection.sql(sql)
    names = sorted(frame.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} != {sorted(relation.columns)}"]
    types = dict(zip(relation.columns, map(str, relation.types)))
    problems = [
        f"{item.name}: {item.dataType.simpleString()} != {types[item.name]}"
        for item in frame.schema
        if KINDS.get(item.dataType.simpleString()) != types[item.name]
    ]
    got = Counter(tuple(map(_plain, row)) for row in frame.select(*names).collect())
    quoted = ", ".join(f'"{name}"' for name in names)
    want = Counter(tuple(map(_plain, row)) for row in connection.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    if not want:
        problems.append("check returns no rows")
    if got != want:
        problems.append(f"rows {got.total()} vs {want.total()}")
        problems.append(f"only in Spark: {str(list((got - want).items())[:2])[:600]}")
        problems.append(f"only in check: {str(list((want - got).items())[:2])[:600]}")
    return problems
