"""Time-series queries: one daily series from orders, and one series per user from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import register, table
from tabsight.catalog.tables import DAILY_SQL, LINE_COLUMNS, daily_orders
from tabsight.functions.columns import rounded
from tabsight.operators import stats
from tabsight.operators import timeseries as ts


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def daily(spark: SparkSession, sf_dir: str) -> ts.Series:
    return ts.Series(daily_orders(spark, sf_dir), "day", "total")


def per_user(spark: SparkSession, sf_dir: str) -> ts.Series:
    return ts.Series(table(spark, sf_dir, "events"), "ts", "value", ["event_id"], ["user_id"])


def all_events(spark: SparkSession, sf_dir: str) -> ts.Series:
    return ts.Series(table(spark, sf_dir, "events"), "ts", "value", ["event_id"])


# each frame: row number x from 0, series size n
_DAILY = f"""(SELECT day AS ts, total AS v, row_number() OVER (ORDER BY day) - 1 AS x, count(*) OVER () AS n FROM ({DAILY_SQL}))"""
_USER = """(SELECT user_id, event_id, ts, value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
_ALL = """(SELECT event_id, ts, value AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS x, count(*) OVER () AS n FROM events)"""


def _ma(over: str) -> str:
    return ", ".join(
        f"CASE WHEN n >= {w} THEN round(avg(v) OVER ({over} ORDER BY x ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) END AS ma_{w}"
        for w in ts.WINDOWS
    )


@register("moving_average", f"SELECT event_id, {_ma('')} FROM {_ALL}")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.moving_average(all_events(spark, sf_dir)).select("event_id", "ma_7", "ma_30", "ma_90")
    return _round(rows, "ma_7", "ma_30", "ma_90")


@register("moving_average_by_user", f"SELECT user_id, event_id, {_ma('PARTITION BY user_id')} FROM {_USER}")
def moving_average_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.moving_average(per_user(spark, sf_dir)).select("user_id", "event_id", "ma_7", "ma_30", "ma_90")
    return _round(rows, "ma_7", "ma_30", "ma_90")


def _ma_raw(source: str, over: str) -> str:
    means = ", ".join(
        f"avg(v) OVER ({over} ORDER BY x ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS ma_{w}" for w in ts.WINDOWS
    )
    return f"SELECT *, {means} FROM {source}"


@register(
    "moving_average_summary",
    " UNION ALL ".join(
        f'SELECT {w}::BIGINT AS "window", round(arg_max(ma_{w}, x), 4) AS current_value, '
        f"round(arg_max(ma_{w}, x) - arg_min(ma_{w}, x), 4) AS change_from_start FROM ({_ma_raw(_DAILY, '')}) HAVING max(n) >= {w}"
        for w in ts.WINDOWS
    ),
)
def moving_average_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.moving_average_summary(daily(spark, sf_dir)), "current_value", "change_from_start", digits=4)


@register(
    "moving_average_summary_by_user",
    " UNION ALL ".join(
        f'SELECT user_id, {w}::BIGINT AS "window", round(arg_max(ma_{w}, x), 6) AS current_value, '
        f"round(arg_max(ma_{w}, x) - arg_min(ma_{w}, x), 6) AS change_from_start "
        f"FROM ({_ma_raw(_USER, 'PARTITION BY user_id')}) GROUP BY user_id HAVING max(n) >= {w}"
        for w in ts.WINDOWS
    ),
)
def moving_average_summary_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.moving_average_summary(per_user(spark, sf_dir)), "current_value", "change_from_start")


def _growth_sql(source: str, over: str, key: str) -> str:
    group = f"GROUP BY {key}" if key else ""
    lead = f"{key}, " if key else ""
    return f"""
    SELECT {lead}round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS std, round(min(g), 6) AS min, round(max(g), 6) AS max FROM (
      SELECT *, v / nullif(lag(v) OVER ({over} ORDER BY x), 0) - 1 AS g FROM {source}) {group} HAVING count(g) > 0"""


@register("growth_pop", _growth_sql(_DAILY, "", ""))
def growth_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.growth(daily(spark, sf_dir)), "mean", "std", "min", "max")


@register("growth_pop_by_user", _growth_sql(_USER, "PARTITION BY user_id", "user_id"))
def growth_pop_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.growth(per_user(spark, sf_dir)), "mean", "std", "min", "max")


@register(
    "growth_yoy",
    f"""
    SELECT round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS std, round(arg_max(g, x) FILTER (WHERE g IS NOT NULL), 6) AS current
    FROM (SELECT *, v / nullif(lag(v, 365) OVER (ORDER BY x), 0) - 1 AS g FROM {_DAILY}) WHERE g IS NOT NULL HAVING count(g) > 0""",
)
def growth_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.growth_yoy(daily(spark, sf_dir)), "mean", "std", "current")


def trend_sql(source: str, key: str) -> str:
    group, lead = (f"GROUP BY {key}", f"{key}, ") if key else ("", "")
    return f"""
    SELECT {lead}n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r * r, 6) AS r_squared,
           round(sqrt(greatest(0, 1 - r * r) * vy / vx / (n - 2)), 6) AS std_error,
           CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
           round(abs(r), 6) AS trend_strength FROM (
      SELECT {lead}count(*) AS n, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, coalesce(corr(v, x), 0) AS r,
             var_pop(v) AS vy, var_pop(x) AS vx FROM {source} {group}) WHERE n >= 3"""


def rounded_trend(df: DataFrame) -> DataFrame:
    return _round(_round(df.drop("p_value"), "slope", "r_squared", "std_error", "trend_strength"), "intercept", digits=4)


@register("linear_trend", trend_sql(_DAILY, ""))
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_trend(ts.linear_trend(daily(spark, sf_dir)))


@register("linear_trend_by_user", trend_sql(_USER, "user_id"))
def linear_trend_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_trend(ts.linear_trend(per_user(spark, sf_dir)))


@register("linear_trend_p_value")
def linear_trend_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.linear_trend(per_user(spark, sf_dir)).select("user_id", "n", rounded("p_value").alias("p_value"))


def _seasonal_sql(source: str, key: str, periods) -> str:
    lead = f"{key}, " if key else ""
    return " UNION ALL ".join(
        f"SELECT {lead}{p}::BIGINT AS period, x % {p} AS phase, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, "
        f"max(v) AS max, count(*) AS count FROM {source} WHERE n >= {2 * p} GROUP BY {lead}x % {p}"
        for p in periods
    )


@register(
    "seasonal_profile",
    f"""
    SELECT period, phase, round(mean, 6) AS mean, round(std, 4) AS std, min, max, count, round(std / nullif(mean, 0), 6) AS cv
    FROM ({_seasonal_sql(_DAILY, '', ts.PERIODS)})""",
)
def seasonal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_round(ts.seasonal_profile(daily(spark, sf_dir)), "cv", "mean"), "std", digits=4)


@register(
    "seasonal_profile_by_user",
    f"""
    SELECT user_id, period, phase, round(mean, 6) AS mean, round(std, 6) AS std, count
    FROM ({_seasonal_sql(_USER, 'user_id', (7, 30))})""",
)
def seasonal_profile_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = ts.seasonal_profile(per_user(spark, sf_dir), (7, 30)).select("user_id", "period", "phase", "mean", "std", "count")
    return _round(profile, "mean", "std")


@register(
    "seasonal_strength",
    f"""
    SELECT period, round(CASE WHEN b + w * w > 0 THEN b / (b + w * w) ELSE 0 END, 6) AS strength FROM (
      SELECT period, var_samp(mean) AS b, avg(std) AS w FROM ({_seasonal_sql(_DAILY, '', ts.PERIODS)}) GROUP BY period)""",
)
def seasonal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.seasonal_strength(daily(spark, sf_dir)), "strength")


def _values(labels) -> str:
    return ", ".join(f"({i}::BIGINT, '{label}')" for i, label in enumerate(labels))


@register(
    "dow_profile",
    f"""
    SELECT c.slot, c.label, round(avg(v), 6) AS mean, round(stddev_samp(v), 4) AS std, count(v) AS count
    FROM (VALUES {_values(ts.WEEKDAYS)}) c(slot, label)
    LEFT JOIN (SELECT isodow(o_orderdate) - 1 AS slot, o_totalprice AS v FROM orders) d ON c.slot = d.slot
    WHERE (SELECT count(*) FROM orders) >= 14 GROUP BY 1, 2""",
)
def dow_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ts.Series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"])
    return _round(_round(ts.dow_profile(s), "mean"), "std", digits=4)


@register(
    "month_profile",
    f"""
    SELECT s.o_orderpriority, c.slot, c.label, round(avg(v), 6) AS mean, round(stddev_samp(v), 4) AS std, count(v) AS count
    FROM (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(*) >= 24) s
    CROSS JOIN (VALUES {_values(ts.MONTHS)}) c(slot, label)
    LEFT JOIN (SELECT o_orderpriority, month(o_orderdate) - 1 AS slot, o_totalprice AS v FROM orders) d
      ON c.slot = d.slot AND s.o_orderpriority = d.o_orderpriority GROUP BY 1, 2, 3""",
)
def month_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ts.Series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"], ["o_orderpriority"])
    return _round(_round(ts.month_profile(s), "mean"), "std", digits=4)


@register(
    "ts_basic",
    """
    SELECT user_id, count(*) AS observations, min(ts) AS first_ts, max(ts) AS last_ts,
           CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS range_days
    FROM events GROUP BY user_id""",
)
def ts_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.basic_metrics(per_user(spark, sf_dir))


_FREQUENCY_LABEL = """CASE WHEN gap <= 3600000000 THEN 'hourly_or_less' WHEN gap <= 86400000000 THEN 'daily'
    WHEN gap <= 604800000000 THEN 'weekly' WHEN gap <= 2678400000000 THEN 'monthly'
    WHEN gap <= 31536000000000 THEN 'yearly' ELSE 'irregular' END"""


@register(
    "frequency_estimate",
    f"""
    SELECT gap AS modal_gap_us, {_FREQUENCY_LABEL} AS frequency FROM (
      SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY x)) AS gap FROM {_DAILY})
    WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1""",
)
def frequency_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.frequency(daily(spark, sf_dir))


@register(
    "frequency_by_user",
    f"""
    SELECT user_id, gap AS modal_gap_us, {_FREQUENCY_LABEL} AS frequency FROM (
      SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, gap) AS rn FROM (
        SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY x)) AS gap FROM {_USER})
      WHERE gap IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
)
def frequency_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.frequency(per_user(spark, sf_dir))


def _volatility_sql(source: str, over: str, key: str) -> str:
    group, lead = (f"GROUP BY {key}", f"{key}, ") if key else ("", "")
    return f"""
    SELECT {lead}round(stddev_samp(g), 6) AS volatility, round(stddev_samp(g) * sqrt(252), 5) AS annualized_volatility,
           round(quantile_cont(g, 0.05), 6) AS value_at_risk_5pct, round(quantile_cont(g, 0.01), 6) AS value_at_risk_1pct FROM (
      SELECT *, v / nullif(lag(v) OVER ({over} ORDER BY x), 0) - 1 AS g FROM {source}) WHERE g IS NOT NULL {group}"""


def _rounded_volatility(df: DataFrame) -> DataFrame:
    fine = _round(df, "volatility", "value_at_risk_5pct", "value_at_risk_1pct")
    return _round(fine, "annualized_volatility", digits=5)


@register("volatility", _volatility_sql(_DAILY, "", ""))
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_volatility(ts.volatility(daily(spark, sf_dir)))


@register("volatility_by_user", _volatility_sql(_USER, "PARTITION BY user_id", "user_id"))
def volatility_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_volatility(ts.volatility(per_user(spark, sf_dir)))


def _drawdown_sql(source: str, over: str, key: str) -> str:
    group, lead = (f"GROUP BY {key}", f"{key}, ") if key else ("", "")
    return f"""
    SELECT {lead}round(min((v - peak) / nullif(peak, 0)), 6) AS max_drawdown FROM (
      SELECT *, max(v) OVER ({over} ORDER BY x ROWS UNBOUNDED PRECEDING) AS peak FROM {source}) {group}"""


@register("max_drawdown", _drawdown_sql(_DAILY, "", ""))
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.max_drawdown(daily(spark, sf_dir)), "max_drawdown")


@register("max_drawdown_by_user", _drawdown_sql(_USER, "PARTITION BY user_id", "user_id"))
def max_drawdown_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.max_drawdown(per_user(spark, sf_dir)), "max_drawdown")


def _momentum_sql(source: str, key: str) -> str:
    on, lead = (f"a.{key} = b.{key} AND", f"a.{key}, ") if key else ("", "")
    return " UNION ALL ".join(
        f"SELECT {lead}{p}::BIGINT AS step, round((a.v - b.v) / nullif(b.v, 0), 6) AS momentum FROM {source} a JOIN {source} b "
        f"ON {on} a.x = a.n - 1 AND b.x = b.n - {p} WHERE a.n >= 10"
        for p in ts.MOMENTUM_STEPS
    )


@register("momentum", _momentum_sql(_DAILY, ""))
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.momentum(daily(spark, sf_dir)), "momentum")


@register("momentum_by_user", _momentum_sql(_USER, "user_id"))
def momentum_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.momentum(per_user(spark, sf_dir)), "momentum")


def _autocorr_sql(source: str, over: str, key: str) -> str:
    group, lead = (f"GROUP BY {key}", f"{key}, ") if key else ("", "")
    lags = range(1, ts.MAX_LAG + 1)
    shifted = ", ".join(f"lag(v, {k}) OVER ({over} ORDER BY x) AS l{k}" for k in lags)
    return f"WITH lagged AS (SELECT *, {shifted} FROM {source}) " + " UNION ALL ".join(
        f"SELECT {lead}{k}::BIGINT AS lag, round(corr(v, l{k}), 6) AS autocorr FROM lagged WHERE l{k} IS NOT NULL {group} "
        f"HAVING max(n) >= 10 AND {k} <= max(n) // 4 AND corr(v, l{k}) IS NOT NULL"
        for k in lags
    )


@register("autocorrelation", _autocorr_sql(_DAILY, "", ""))
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.autocorrelation(daily(spark, sf_dir)), "autocorr")


@register("autocorrelation_by_user", _autocorr_sql(_USER, "PARTITION BY user_id", "user_id"))
def autocorrelation_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ts.autocorrelation(per_user(spark, sf_dir)), "autocorr")


@register(
    "minmax_level",
    f"""
    SELECT x AS position, CAST(floor((v - lo) / nullif(hi - lo, 0) * 9) AS BIGINT) AS level
    FROM {_DAILY}, (SELECT min(total) AS lo, max(total) AS hi FROM ({DAILY_SQL})) WHERE x < 80""",
)
def minmax_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.minmax_level(daily(spark, sf_dir))


@register(
    "mean_position",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(floor((avg({c}) - min({c})) / nullif(max({c}) - min({c}), 0) * 70) AS BIGINT) AS mean_pos FROM lineitem"
        for c in LINE_COLUMNS
    ),
)
def mean_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.mean_position(stats.scalar_stats(table(spark, sf_dir, "lineitem"), LINE_COLUMNS, ("mean", "min", "max")))
