"""Compare a Spark result with the SQL result, regardless of row order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _kind(type_name: str) -> str:
    name = type_name.lower()
    if name.startswith(("decimal", "hugeint")):
        return name
    if "int" in name:
        return "integer"
    return {"varchar": "string"}.get(name, name)


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    number = float(value)
    if math.isnan(number):
        return "NaN"
    return number


def rows_by_name(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; empty if columns and rows agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(frame.columns):
        missing, extra = set(names) - set(frame.columns), set(frame.columns) - set(names)
        return [f"columns: Spark lacks {sorted(missing)}, has besides {sorted(extra)}"]
    kinds = {column[0]: _kind(str(column[1])) for column in result.description}
    found = [
        f"type of {name}: Spark {kind}, SQL {kinds[name]}"
        for name, kind in frame.dtypes
        if _kind(kind) != kinds[name]
    ]
    expected = rows_by_name(names, result.fetchall())
    actual = rows_by_name(frame.columns, [tuple(row) for row in frame.collect()])
    if sum(expected.values()) != sum(actual.values()):
        found.append(f"rows: Spark {sum(actual.values())}, SQL {sum(expected.values())}")
    only_spark, only_sql = actual - expected, expected - actual
    if only_spark or only_sql:
        order = sorted(frame.columns)
        found.append(f"columns {order}")
        found += [f"only Spark ({len(only_spark)}): {row}" for row in sorted(only_spark, key=str)[:2]]
        found += [f"only SQL ({len(only_sql)}): {row}" for row in sorted(only_sql, key=str)[:2]]
    return found
