"""Checks of a table against its data dictionary; results are rows, never one large set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import present
from tabsight.operators.clean import coerce_numeric
from tabsight.operators.keys import check_keys
from tabsight.sources.dictionary import ColumnRule, Keys

_ISSUE = "severity string, rule string, column string, n bigint"


def check_columns(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Missing columns (error) and extra columns (warning) by anti-joins of the name lists."""
    present = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    missing = dictionary.select("column").join(present, "column", "left_anti").select(
        F.lit("error").alias("severity"), F.lit("missing_column").alias("rule"), "column"
    )
    extra = present.join(dictionary.select("column"), "column", "left_anti").select(
        F.lit("warning").alias("severity"), F.lit("extra_column").alias("rule"), "column"
    )
    return missing.unionByName(extra).withColumn("n", F.lit(1).cast("bigint"))


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _ISSUE)


Check = tuple[str, str, str, Column]  # severity, rule, column, condition of a bad value


def _counted(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Issues of all checks that hold somewhere, from one scan."""
    if not checks:
        return _empty(df)
    wide = df.agg(*[F.count_if(bad).alias(f"n{i}") for i, (_, _, _, bad) in enumerate(checks)])
    cells = [
        F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n"))
        for i, (severity, rule, c, _) in enumerate(checks)
    ]
    return wide.select(F.inline(F.array(*cells))).filter(F.col("n") > 0)


def _null_checks(df: DataFrame, rules: Mapping[str, ColumnRule]) -> list[Check]:
    return [
        ("error", "nullability", c, present(df, c).isNull())
        for c, r in rules.items()
        if not r.is_nullable and c in df.columns
    ]


def _range_checks(df: DataFrame, rules: Mapping[str, ColumnRule]) -> list[Check]:
    checks = []
    for c, r in rules.items():
        if c in df.columns and r.valid_range and r.data_type == "NUMERICAL":
            low, high = r.valid_range
            value = F.nanvl(coerce_numeric(F.col(f"`{c}`")), F.lit(None).cast("double"))
            checks.append(("warning", "range", c, (value < low) | (value > high)))
    return checks


def check_nullability(df: DataFrame, rules: Mapping[str, ColumnRule]) -> DataFrame:
    """Non-nullable columns that hold nulls (error), with the count."""
    return _counted(df, _null_checks(df, rules))


def check_range(df: DataFrame, rules: Mapping[str, ColumnRule]) -> DataFrame:
    """Values outside the valid range of numerical columns (warning), with the count."""
    return _counted(df, _range_checks(df, rules))


def invalid_values(df: DataFrame, rules: Mapping[str, ColumnRule]) -> DataFrame:
    """(column, value, n): values outside the categorical list, each with its count."""
    cells = []
    for c, r in rules.items():
        if c in df.columns and r.categorical_values and r.data_type == "CATEGORICAL":
            value = F.col(f"`{c}`").cast("string")
            cells.append(F.when(~value.isin(*r.categorical_values), F.struct(F.lit(c).alias("column"), value.alias("value"))))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    found = df.select(F.inline(F.array_compact(F.array(*cells))))
    return found.groupBy("column", "value").agg(F.count("*").alias("n"))


def check_domain(df: DataFrame, rules: Mapping[str, ColumnRule]) -> DataFrame:
    """Columns with values outside their list (warning); n is the number of distinct bad values."""
    return invalid_values(df, rules).groupBy("column").agg(F.count("*").alias("n")).select(
        F.lit("warning").alias("severity"), F.lit("domain").alias("rule"), "column", "n"
    )


def validate(
    df: DataFrame, dictionary: DataFrame, rules: Mapping[str, ColumnRule], keys: Keys | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """All issues, one row each; ``keys`` are checked too where given, against the ``tables`` they refer to."""
    issues = (
        check_columns(df, dictionary)
        .unionByName(_counted(df, _null_checks(df, rules) + _range_checks(df, rules)))
        .unionByName(check_domain(df, rules))
    )
    return issues.unionByName(check_keys(df, keys, tables)) if keys else issues


def verdict(issues: DataFrame) -> DataFrame:
    """One row: valid iff there is no error."""
    return issues.agg(
        (F.count_if(F.col("severity") == "error") == 0).alias("is_valid"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
