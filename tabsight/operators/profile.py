"""Table profile: semantic types, missing values, distinct counts, size in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabsight.functions.columns import TEMPORAL_TYPES, present, unpivot_wide

# Date shapes (searched inside the text) and boolean spellings.
DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}")
TRUE_TOKENS = ("true", "yes", "1", "t", "y")
FALSE_TOKENS = ("false", "no", "0", "f", "n")

TEMPORAL_SHARE = 0.5
CATEGORY_LIMIT = 50
CATEGORY_RATIO = 0.5
MISSING_ALERT_PERCENT = 50.0
SAMPLE_ROWS = 1000
# distinct estimates above this cannot belong to a column with CATEGORY_LIMIT values or fewer
_SURELY_TOO_MANY = 20 * CATEGORY_LIMIT
_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def sample_head(df: DataFrame, order_by: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in a stated order (a top-k, not a sort of the table)."""
    return df.orderBy(*order_by).limit(rows)


def _countable(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (T.MapType, T.VariantType))


def _distinct_key(df: DataFrame, field: T.StructField) -> Column:
    """What to shuffle for an exact distinct count: long text travels as its digest."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.when(F.octet_length(c) > 64, F.unhex(F.sha2(c, 256))).otherwise(c.cast("binary"))
    return present(df, field.name)


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, percent): one scan, one row per column."""
    names = df.columns
    aggs = [F.count("*").alias("rows")] + [F.count(present(df, c)).alias(f"{c}__present") for c in names]
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"`{c}__present`")).alias("missing")) for c in names]
    )
    long = df.agg(*aggs).select("rows", F.inline(cells))
    percent = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows") * 100).otherwise(0.0)
    return long.select("column", "missing", percent.alias("percent"))


def missing_alerts(report: DataFrame, threshold: float = MISSING_ALERT_PERCENT) -> DataFrame:
    """Columns with any missing value; ``high`` marks those above the threshold percent."""
    return report.filter(F.col("missing") > 0).withColumn("high", F.col("percent") > threshold)


def missing_top(report: DataFrame, limit: int = 5) -> DataFrame:
    """Columns with the most missing values, next to the table's total."""
    # the report has one row per column, so one window over all of it is small
    total = F.sum("missing").over(W.partitionBy(F.lit(0)))
    return report.withColumn("total_missing", total).orderBy(F.desc("missing"), "column").limit(limit)


def data_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, missing, distinct, memory_mb) for every column."""
    fields = [f for f in df.schema.fields]
    aggs: list[Column] = [F.count("*").alias("rows")]
    for f in fields:
        c = present(df, f.name)
        aggs.append(F.count(c).alias(f"{f.name}__present"))
        aggs.append((F.count_distinct(_distinct_key(df, f)) if _countable(f) else F.lit(0)).alias(f"{f.name}__distinct"))
        width = _FIXED_WIDTH.get(type(f.dataType))
        if width:
            size = F.count(c) * width
        else:
            text = c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else c.cast("string")
            size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
        aggs.append(size.alias(f"{f.name}__bytes"))
    wide = df.agg(*aggs)
    long = unpivot_wide(wide, ["rows"], [f.name for f in fields], ["present", "distinct", "bytes"])
    dtypes = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "column string, dtype string")
    return long.join(F.broadcast(dtypes), "column").select(  # one row per column of the table
        "column",
        "dtype",
        "rows",
        (F.col("rows") - F.col("present")).alias("missing"),
        "distinct",
        (F.col("bytes") / (1024.0 * 1024.0)).alias("memory_mb"),
    )


def dtype_histogram(profile: DataFrame) -> DataFrame:
    """Number of columns per type, by type name."""
    return profile.groupBy("dtype").agg(F.count("*").alias("columns")).orderBy("dtype")


def _numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def detect_types(df: DataFrame) -> DataFrame:
    """(column, data_type) with the first match of temporal, numerical, boolean, categorical, text.

    One scan decides everything except the exact distinct count, which a second scan takes
    only for columns whose sketch says that the category limit is within reach.
    """
    fields = df.schema.fields
    aggs: list[Column] = []
    for i, f in enumerate(fields):
        c = present(df, f.name)
        aggs.append(F.count(c).alias(f"n{i}"))
        if isinstance(f.dataType, T.StringType):
            dated = F.lit(False)
            for pattern in DATE_PATTERNS:
                dated = dated | c.rlike(pattern)
            lowered = F.lower(c)
            token = lowered.isin(*TRUE_TOKENS, *FALSE_TOKENS)
            aggs += [
                F.avg(dated.cast("int")).alias(f"d{i}"),
                F.bool_and(token).alias(f"b{i}"),
                F.size(F.collect_set(F.when(token, lowered))).alias(f"k{i}"),  # at most ten tokens
            ]
        if not _numeric(f) and _countable(f):
            aggs.append(F.approx_count_distinct(c).alias(f"u{i}"))
    seen = df.agg(*aggs).first().asDict()

    decided: dict[str, str] = {}
    open_columns: list[T.StructField] = []
    for i, f in enumerate(fields):
        if not seen[f"n{i}"]:
            decided[f.name] = "TEXT"
        elif isinstance(f.dataType, TEMPORAL_TYPES) or (seen.get(f"d{i}") or 0) > TEMPORAL_SHARE:
            decided[f.name] = "TEMPORAL"
        elif _numeric(f):
            decided[f.name] = "NUMERICAL"
        elif isinstance(f.dataType, T.BooleanType) or (seen.get(f"b{i}") and seen[f"k{i}"] <= 2):
            decided[f.name] = "BOOLEAN"
        elif seen.get(f"u{i}", _SURELY_TOO_MANY + 1) > _SURELY_TOO_MANY:
            decided[f.name] = "TEXT"
        else:
            open_columns.append(f)
    if open_columns:
        exact = df.agg(*[F.count_distinct(F.col(f"`{f.name}`")).alias(f.name) for f in open_columns]).first()
        for f in open_columns:
            values = seen[f"n{fields.index(f)}"]
            few = exact[f.name] <= CATEGORY_LIMIT and exact[f.name] / values < CATEGORY_RATIO
            decided[f.name] = "CATEGORICAL" if few else "TEXT"
    return df.sparkSession.createDataFrame([(f.name, decided[f.name]) for f in fields], "column string, data_type string")
