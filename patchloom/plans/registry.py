"""Registered queries: a function (spark, folder of tables) -> DataFrame, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchloom.plans.inputs import SELECTS, as_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, inputs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function under its name; inputs names SELECTS that stand before sql as common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(f"{name}_in AS ({as_sql(SELECTS[name])})" for name in inputs)
            body = sql.strip()
            SQL[f.__name__] = f"WITH {head}{', ' + body[5:] if body[:5].upper() == 'WITH ' else ' ' + body}" if head else body
        return f

    return add
