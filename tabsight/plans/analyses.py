"""Targeted and full runs: choose analyses, get lazy long tables, unite them on request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tabsight.functions.columns import numeric_columns, temporal_column
from tabsight.operators import correlation, outliers, stats, timeseries

ANALYSES = ("descriptive", "correlation", "outliers", "aggregation", "timeseries")
DEFAULT_ANALYSES = ("descriptive", "correlation")
MIN_SERIES_ROWS = 3


def _melted(frame: DataFrame, analysis: str, item: list, stats_: Sequence[str]) -> DataFrame:
    """(analysis, item, stat, value) from a wide result."""
    name = F.concat_ws(" | ", *[F.col(c).cast("string") for c in item]).alias("item")
    cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats_])
    return frame.select(F.lit(analysis).alias("analysis"), name, F.inline(cells))


def descriptive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _melted(stats.describe(df, columns), "descriptive", ["column"], stats.DESCRIBE_STATS)


def correlations(df: DataFrame, columns: Sequence[str], methods: Sequence[str] = correlation.METHODS) -> DataFrame:
    return _melted(correlation.correlations(df, columns, methods), "correlation", ["method", "col1", "col2"], ["corr"])


def outlier_counts(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], methods: Sequence[str] = outliers.DEFAULT_METHODS
) -> DataFrame:
    grid = outliers.method_grid(df, columns, methods)
    summary = outliers.summarize(outliers.detect(df, ids, columns, methods), grid)
    return _melted(summary, "outliers", ["method", "column"], ["count", "percent"])


def aggregation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    frame = stats.aggregate(df, columns)
    return _melted(frame, "aggregation", ["column"], [c for c in frame.columns if c != "column"])


def trends(df: DataFrame, columns: Sequence[str], ts: str, ids: Sequence[str]) -> DataFrame:
    """(column, linear trend…) for every column with enough values."""
    out = None
    for c in columns:
        one = timeseries.linear_trend(timeseries.Series(df, ts, c, ids)).withColumn("column", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


def melted_trend(frame: DataFrame, column: str) -> DataFrame:
    """Linear trend of one column as (analysis, item, stat, value)."""
    names = ["slope", "intercept", "r_squared", "std_error", "p_value", "trend_strength"]
    return _melted(frame.withColumn("column", F.lit(column)), "timeseries.trend", ["column", "trend_direction"], names)


def series(df: DataFrame, columns: Sequence[str], ids: Sequence[str], date_column: str | None = None) -> DataFrame | None:
    """Trend, growth, seasonality, volatility, momentum and autocorrelation of each column over time."""
    ts = temporal_column(df, date_column)
    if ts is None:
        return None
    out = None

    def keep(part: DataFrame) -> None:
        nonlocal out
        out = part if out is None else out.unionByName(part)

    def add(frame: DataFrame, analysis: str, item: list, names: Sequence[str]) -> None:
        keep(_melted(frame, analysis, item, names))

    for c in columns:
        s = timeseries.Series(df, ts, c, ids)
        if s.numbered.total < MIN_SERIES_ROWS:
            continue
        named = lambda frame, c=c: frame.withColumn("column", F.lit(c))
        keep(melted_trend(timeseries.linear_trend(s), c))
        add(named(timeseries.moving_average_summary(s)), "timeseries.moving_average", ["column", "window"],
            ["current_value", "change_from_start"])
        add(named(timeseries.growth(s)), "timeseries.growth", ["column"], ["mean", "std", "min", "max"])
        add(named(timeseries.growth_yoy(s)), "timeseries.growth_yoy", ["column"], ["mean", "std", "current"])
        add(named(timeseries.seasonal_strength(s)), "timeseries.seasonal_strength", ["column", "period"], ["strength"])
        add(named(timeseries.dow_profile(s)), "timeseries.day_of_week", ["column", "label"], ["mean", "std", "count"])
        add(named(timeseries.month_profile(s)), "timeseries.month", ["column", "label"], ["mean", "std", "count"])
        add(named(timeseries.basic_metrics(s)), "timeseries.basic", ["column"], ["observations", "range_days"])
        add(named(timeseries.volatility(s)), "timeseries.volatility", ["column"],
            ["volatility", "annualized_volatility", "value_at_risk_5pct", "value_at_risk_1pct"])
        add(named(timeseries.max_drawdown(s)), "timeseries.drawdown", ["column"], ["max_drawdown"])
        add(named(timeseries.momentum(s)), "timeseries.momentum", ["column", "step"], ["momentum"])
        add(named(timeseries.autocorrelation(s)), "timeseries.autocorrelation", ["column", "lag"], ["autocorr"])
    return out


def failure(df: DataFrame, kind: str, error: Exception) -> DataFrame:
    """The row that stands for an analysis that could not be planned: stat ``error``, the message as item."""
    message = f"{type(error).__name__}: {str(error)[:300]}"
    return df.sparkSession.createDataFrame([(kind, message, "error", None)], "analysis string, item string, stat string, value double")


def analyze(
    df: DataFrame,
    ids: Sequence[str],
    analyses: Sequence[str | Mapping] | None = None,
    columns: Sequence[str] | None = None,
    date_column: str | None = None,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    """Long tables by analysis name; planning them may count and bound things in eager jobs.

    An entry of ``analyses`` is a name or a mapping with ``type`` and optional ``columns`` and
    ``methods``; unknown names are ignored; an analysis that fails while it is planned gives one
    row that says so, and the others go on.  Without analyses the default is descriptive and
    correlation on all numeric columns, or the first ``limit``.
    """
    if not analyses:
        analyses = DEFAULT_ANALYSES
        columns = columns or [c for c in numeric_columns(df) if c not in ids][:limit]
    results: dict[str, DataFrame] = {}
    for entry in analyses:
        spec = {"type": entry} if isinstance(entry, str) else dict(entry)
        wanted = spec.get("columns") or columns
        names = numeric_columns(df, wanted) if wanted else [c for c in numeric_columns(df) if c not in ids]
        methods = {"methods": spec["methods"]} if spec.get("methods") else {}
        kind = spec.get("type")
        try:
            if kind == "descriptive":
                results[kind] = descriptive(df, names)
            elif kind == "correlation" and len(names) > 1:
                results[kind] = correlations(df, names, **methods)
            elif kind == "outliers":
                results[kind] = outlier_counts(df, names, ids, **methods)
            elif kind == "aggregation":
                results[kind] = aggregation(df, names)
            elif kind == "timeseries":
                table = series(df, names, ids, date_column)
                if table is not None:
                    results[kind] = table
        except Exception as error:  # noqa: BLE001  (one analysis must not lose the others)
            results[kind] = failure(df, kind, error)
    return results


def full_run(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None, **options) -> dict[str, DataFrame]:
    """Every analysis; ``options`` as for ``analyze``."""
    return analyze(df, ids, options.pop("analyses", ANALYSES), columns, **options)


def unite(results: Mapping[str, DataFrame]) -> DataFrame:
    """One long table (analysis, item, stat, value)."""
    out = None
    for frame in results.values():
        out = frame if out is None else out.unionByName(frame)
    return out
