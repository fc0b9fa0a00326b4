"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _family(type_name: str) -> str:
    name = str(type_name).lower()
    return {"int": "integer", "varchar": "string"}.get(name, name)


def sql_result(connection, sql: str):
    """Column names with types, and rows in column-name order."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: _family(d[1]) for d in cursor.description}
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    return {n: types[n] for n in sorted(names)}, rows


def spark_result(df):
    names = sorted(df.columns)
    types = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    return {n: types[n] for n in names}, [tuple(r) for r in df.select(*names).collect()]


def compare(actual, expected) -> str | None:
    """What differs, or None."""
    if actual[0] != expected[0]:
        return f"schema: {actual[0]} != {expected[0]}"
    got, want = Counter(actual[1]), Counter(expected[1])
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {len(actual[1])} vs {len(expected[1])}; extra {extra}; missing {missing}"
    return None
