"""Query registry: name -> Spark query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def literals(values) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def table(rows, columns: str) -> str:
    """VALUES table of Python rows for the SQL side."""

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(cell(x) for x in v) + "]" if v else "CAST([] AS VARCHAR[])"
        return text(str(v))

    body = ", ".join("(" + ", ".join(cell(c) for c in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"
