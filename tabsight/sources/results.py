"""Result sink: findings tables as parquet, JSON or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "json", "csv")


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a long result table; every task writes its own part files."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_results(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """Read a written result back with its schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
