"""All plans by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None):
    """Register a plan under its function's name, with its DuckDB SQL if there is one."""

    def add(f):
        PLANS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
