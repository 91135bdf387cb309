"""Registry of named queries over the test tables, each with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` computes the same rows from the same tables."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_sql(source: str, columns: dict[str, str], keys: str = "") -> str:
    """SQL for (keys, column, value) cells without nulls; ``columns`` maps names to expressions."""
    lead = f"{keys}, " if keys else ""
    parts = [
        f"SELECT {lead}'{name}' AS \"column\", CAST({expr} AS DOUBLE) AS value FROM {source} WHERE ({expr}) IS NOT NULL"
        for name, expr in columns.items()
    ]
    return " UNION ALL ".join(parts)
