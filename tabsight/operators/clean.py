"""Column cleaning: dictionary-driven coercion and general normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabsight.operators.profile import FALSE_TOKENS, TRUE_TOKENS
from tabsight.sources.dictionary import ColumnRule

# Formats tried in turn (they follow the date shapes of type inference) and
# the shape of a number in text.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy")
NUMBER_PATTERN = r"^-?\d+\.?\d*$"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"
ISO_OFFSET = r"[T ]\d{1,2}:\d{2}\S*\s?(?:Z|UTC|[+-]\d{2}:?\d{2})$"


def coerce_numeric(c: Column) -> Column:
    """Text to double, null where it does not parse."""
    return F.trim(c.cast("string")).try_cast("double")


def coerce_temporal(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to timestamp, else null: ISO shapes with any fraction first, then the first format that parses.

    A time with an offset (or Z) becomes the same instant in UTC; others are taken as written.
    """
    text = F.trim(c)
    iso = F.when(text.rlike(ISO_DATE), text)
    # +0200 is read as +02:00
    spelled = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), spelled.try_cast("timestamp").cast("timestamp_ntz"))
    plain = F.when(text.rlike(ISO_OFFSET), instant).otherwise(iso.try_cast("timestamp_ntz"))
    return F.coalesce(plain, *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def coerce_boolean(c: Column) -> Column:
    """Ten spellings of true and false, in any case; anything else is null."""
    lowered = F.lower(c)
    return F.when(lowered.isin(*TRUE_TOKENS), True).when(lowered.isin(*FALSE_TOKENS), False)


def coerce_categorical(c: Column, allowed: Sequence[str]) -> Column:
    """Keep listed values, null the others."""
    return F.when(c.isin(*allowed), c)


def _by_rule(field: T.StructField, rule: ColumnRule) -> Column:
    c = F.col(f"`{field.name}`")
    is_text = isinstance(field.dataType, T.StringType)
    if rule.data_type == "NUMERICAL":
        return coerce_numeric(c) if is_text else c.try_cast("double")
    if rule.data_type == "TEMPORAL" and is_text:
        return coerce_temporal(c)
    if rule.data_type == "BOOLEAN" and is_text:
        return coerce_boolean(c)
    if rule.data_type == "CATEGORICAL" and rule.categorical_values:
        return coerce_categorical(c, rule.categorical_values)
    return c


def general_normalize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trim text, empty text to null, and turn all-number text columns into doubles."""
    return normalize(df, {}, columns)


def normalize(df: DataFrame, rules: Mapping[str, ColumnRule], columns: Sequence[str] | None = None) -> DataFrame:
    """Apply a column's dictionary rule, or general normalisation where there is none.

    Whether a text column is all numbers is one decision row for the whole table; the
    cleaning itself is a projection.
    """
    chosen = set(df.columns if columns is None else columns)
    text = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name in chosen and f.name not in rules
    ]
    stripped = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in text}
    numeric: set[str] = set()
    if text:
        row = df.agg(*[F.bool_and(stripped[c].rlike(NUMBER_PATTERN)).alias(f"n{i}") for i, c in enumerate(text)]).first()
        numeric = {c for i, c in enumerate(text) if row[f"n{i}"]}
    out = []
    for f in df.schema.fields:
        if f.name in rules and f.name in chosen:
            value = _by_rule(f, rules[f.name])
        elif f.name in numeric:
            value = stripped[f.name].try_cast("double")
        else:
            value = stripped.get(f.name, F.col(f"`{f.name}`"))
        out.append(value.alias(f.name))
    return df.select(*out)
