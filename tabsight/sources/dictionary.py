"""Data dictionaries: JSON text or file to typed column rules."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

DATA_TYPES = ("NUMERICAL", "CATEGORICAL", "TEMPORAL", "TEXT", "BOOLEAN")
_COLUMN = (
    "struct<data_type:string,description:string,unit:string,valid_range:array<double>,"
    "categorical_values:array<string>,is_nullable:boolean>"
)
_DICTIONARY = f"struct<columns:map<string,{_COLUMN}>,primary_keys:array<string>>"
_KEYS = "struct<primary_keys:array<string>,foreign_keys:array<struct<columns:array<string>,table:string,references:array<string>>>>"


@dataclass(frozen=True)
class ColumnRule:
    """What the dictionary says about one column."""

    name: str
    data_type: str
    description: str = ""
    unit: str | None = None
    valid_range: tuple[float, float] | None = None
    categorical_values: tuple[str, ...] = ()
    is_nullable: bool = True


def dictionary_columns(raw: DataFrame, detected: DataFrame | None = None) -> DataFrame:
    """One row per dictionary column from a frame with one JSON document in ``value``.

    The type is the declared one if it is known, else the detected one, else TEXT.
    ``detected`` is the (column, data_type) frame of type inference.
    """
    parsed = raw.select(F.from_json("value", _DICTIONARY).alias("d"))
    rows = parsed.select(F.explode("d.columns").alias("column", "rule"))
    declared = F.upper("rule.data_type")
    rows = rows.select(
        "column",
        F.when(declared.isin(*DATA_TYPES), declared).alias("declared"),
        F.coalesce("rule.description", F.lit("")).alias("description"),
        F.col("rule.unit").alias("unit"),
        F.col("rule.valid_range").alias("valid_range"),
        F.col("rule.categorical_values").alias("categorical_values"),
        F.coalesce("rule.is_nullable", F.lit(True)).alias("is_nullable"),
    )
    if detected is None:
        rows = rows.withColumn("found", F.lit(None).cast("string"))
    else:
        rows = rows.join(detected.select("column", F.col("data_type").alias("found")), "column", "left")
    kind = F.coalesce("declared", "found", F.lit("TEXT")).alias("data_type")
    return rows.select(
        "column", kind, "description", "unit", "valid_range", "categorical_values", "is_nullable"
    )


def read_dictionary(spark: SparkSession, path: str, detected: DataFrame | None = None) -> DataFrame:
    """Dictionary rows of a JSON file."""
    return dictionary_columns(spark.read.text(path, wholetext=True), detected)


def parse_dictionary(spark: SparkSession, text: str, detected: DataFrame | None = None) -> DataFrame:
    """Dictionary rows of JSON text."""
    return dictionary_columns(spark.createDataFrame([(text,)], "value string"), detected)


def rules_of(columns: DataFrame) -> Mapping[str, ColumnRule]:
    """Dictionary rows (metadata: one per column of a table) as rules to build expressions from."""
    rules = {}
    for r in columns.collect():
        bounds = tuple(r["valid_range"]) if r["valid_range"] and len(r["valid_range"]) == 2 else None
        rules[r["column"]] = ColumnRule(
            r["column"], r["data_type"], r["description"], r["unit"], bounds,
            tuple(r["categorical_values"] or ()), r["is_nullable"],
        )
    return rules


@dataclass(frozen=True)
class ForeignKey:
    """Columns whose values must be in ``references`` of ``table``."""

    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]


@dataclass(frozen=True)
class Keys:
    """The keys of a dictionary."""

    primary: tuple[str, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()


def keys_of(spark: SparkSession, text: str) -> Keys:
    """``primary_keys`` and ``foreign_keys`` of JSON text.

    A foreign key is an object with ``columns``, ``table`` and ``references`` (by default the same names); entries
    without a table, without columns or with another number of references are left out.
    """
    row = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", _KEYS).alias("d")).first()["d"]
    foreign = []
    for k in (row["foreign_keys"] if row else None) or []:
        columns = tuple(c for c in (k["columns"] if k else None) or () if c)
        references = tuple((k["references"] if k else None) or columns)
        if columns and k["table"] and len(columns) == len(references):
            foreign.append(ForeignKey(columns, k["table"], references))
    return Keys(tuple(c for c in (row["primary_keys"] if row else None) or () if c), tuple(foreign))
