"""The queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A WITH item of literal rows."""
    shown = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else text(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {shown})"
