"""Descriptive statistics and the eight aggregation methods, globally or by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import numeric_columns, select_numeric
from tabsight.functions.moments import sample_kurtosis, sample_skewness
from tabsight.operators.quantiles import GROUP_ROWS, exact_quantiles, grouped_quantiles, largest_group, melt

SCALAR_STATS = ("count", "mean", "std", "var", "min", "max", "skewness", "kurtosis")
AGGREGATIONS = ("sum", "count", "mean", "median", "std", "min", "max", "quantile")
AGGREGATION_QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95)


def _scalar(stat: str, c: str) -> Column:
    return {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)),
        "count": lambda: F.count(c),
        "mean": lambda: F.avg(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "skewness": lambda: sample_skewness(c),
        "kurtosis": lambda: sample_kurtosis(c),
    }[stat]()


def scalar_stats(
    df: DataFrame, columns: Sequence[str], stats: Sequence[str], keys: Sequence[str] = (), keep_missing: bool = False
) -> DataFrame:
    """(keys…, column, stats…) in one scan.

    Cells are melted inside the scan stage and aggregated partially there, so only one row
    per column and group is shuffled; a wide aggregate over many columns outgrows code
    generation and is several times slower.  ``keep_missing`` also reports columns (and
    groups) without any value.
    """
    cells = melt(df, keys, columns, keep_missing)
    return cells.groupBy(*keys, "column").agg(*[_scalar(s, "value").alias(s) for s in stats])


def _quantile_frame(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys…, column, q): quantile arrays, with literals for the ungrouped case."""
    if keys:
        return grouped_quantiles(df, keys, columns, probs)
    values = exact_quantiles(df, columns, probs)
    return df.sparkSession.createDataFrame(
        [(c, values[c]) for c in columns], "column string, q array<double>"
    )


def mode_by_column(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, mode, mode_count): most frequent value, the smallest on ties."""
    scope = [*keys, "column"]
    counts = melt(df, keys, columns).groupBy(*scope, "value").agg(F.count("*").alias("n"))
    return counts.groupBy(*scope).agg(
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), F.max("n").alias("mode_count")
    )


def order_stats(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), direct_rows: int = GROUP_ROWS
) -> DataFrame:
    """(keys…, column, q, mode, mode_count) from one value histogram while groups are small."""
    scope = [*keys, "column"]
    if largest_group(df, keys) > direct_rows:
        return _quantile_frame(df, columns, probs, keys).join(mode_by_column(df, columns, keys), scope, "left")
    counts = melt(df, keys, columns).groupBy(*scope, "value").agg(F.count("*").alias("n"))
    return counts.groupBy(*scope).agg(
        F.percentile("value", F.lit(list(map(float, probs))), F.col("n")).alias("q"),
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"),
        F.max("n").alias("mode_count"),
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Descriptive statistics, one row per (keys…, column); columns without values are left out."""
    names = [c for c in numeric_columns(df, columns) if c not in keys]
    data = select_numeric(df, names, keep=keys)
    if keys:
        data = data.dropna(subset=list(keys))
    scope = [*keys, "column"]
    base = scalar_stats(data, names, SCALAR_STATS, keys)
    ordered = order_stats(data, names, (0.25, 0.5, 0.75), keys).select(
        *scope,
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q75"),
        "mode",
        "mode_count",
    )
    joined = base.join(ordered, scope, "left")
    return joined.withColumn("iqr", F.col("q75") - F.col("q25"))


DESCRIBE_STATS = (
    "count", "mean", "median", "std", "var", "min", "max", "skewness", "kurtosis", "q25", "q75", "iqr", "mode", "mode_count",
)


def long_form(wide: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """(keys…, stat, value): one line per statistic; the order of ``stats`` is kept."""
    cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats])
    return wide.select(*keys, F.inline(cells))


def aggregate(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    methods: Sequence[str] = AGGREGATIONS,
    group_by: str | None = None,
) -> DataFrame:
    """The requested aggregation methods, one row per column (and group); null groups are dropped."""
    keys = [group_by] if group_by else []
    names = [c for c in numeric_columns(df, columns) if c not in keys]
    data = select_numeric(df, names, keep=keys)
    if keys:
        data = data.dropna(subset=keys)
    scope = [*keys, "column"]
    scalars = [m for m in methods if m not in ("median", "quantile")]
    result = scalar_stats(data, names, scalars or ["count"], keys, keep_missing=True)
    if not keys:  # an empty table still has its columns
        listed = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
        result = listed.join(result, "column", "left").fillna(0, subset=[m for m in ("sum", "count") if m in result.columns])
    if not scalars:
        result = result.drop("count")
    probs = list(AGGREGATION_QUANTILES) if "quantile" in methods else []
    if "median" in methods:
        probs.append(0.5)
    if probs:
        fields = [F.col("q")[i].alias(f"q{int(q * 100)}") for i, q in enumerate(probs[: len(AGGREGATION_QUANTILES)])]
        if "quantile" not in methods:
            fields = []
        if "median" in methods:
            fields.append(F.col("q")[len(probs) - 1].alias("median"))
        result = result.join(_quantile_frame(data, names, probs, keys).select(*scope, *fields), scope, "left")
    return result
