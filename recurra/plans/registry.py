"""Named queries: a DataFrame builder, and where SQL can express it the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(*names: str) -> str:
    """SQL select items rounding each column to six digits under its own name."""
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names)


def with_ctes(*ctes: str, tail: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + tail
