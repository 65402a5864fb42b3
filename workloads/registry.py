"""Where workloads register: a Spark query and, if there is one, the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def workload(name: str, sql: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(text: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(n)})" for n in needles) + ")"


def count_sql(text: str, needles: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {quoted(n)})::INT" for n in needles) + ")"


def labels_sql(conditions: dict[str, str]) -> str:
    """A list of the labels whose condition holds."""
    items = ", ".join(f"CASE WHEN {c} THEN {quoted(label)} END" for label, c in conditions.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"
