"""Schema helpers: which columns an analysis runs on, and reshaping wide results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns of the table; a given list keeps only those that exist and are numeric."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    wanted = df.columns if columns is None else columns
    return [c for c in wanted if c in numeric]


def temporal_column(df: DataFrame, explicit: str | None = None) -> str | None:
    """The date column: the named one if it exists, else the first temporal column."""
    if explicit and explicit in df.columns:
        return explicit
    return next((f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL_TYPES)), None)


def number(df: DataFrame, column: str) -> Column:
    """The column as double, with NaN as null: both mean a missing value."""
    value = F.col(f"`{column}`").cast("double")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(value, F.lit(None).cast("double"))
    return value


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN as null, in its own type; for counting values."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return number(df, column)
    return F.col(f"`{column}`")


def select_numeric(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Project to ``keep`` plus the usable numeric columns as doubles."""
    chosen = [c for c in numeric_columns(df, columns) if c not in keep]
    return df.select(*keep, *[number(df, c).alias(c) for c in chosen])


def unpivot_wide(
    wide: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str], name: str = "{c}__{s}"
) -> DataFrame:
    """One row per column from a wide aggregate whose fields are ``name.format(c=…, s=…)``."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"`{name.format(c=c, s=s)}`").alias(s) for s in stats])
            for c in columns
        ]
    )
    return wide.select(*keys, F.inline(cells))


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end`` on wall-clock time, whatever the session time zone."""
    gap = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), gap).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), gap)
    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")
