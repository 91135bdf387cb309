"""Time-series metrics for one series or many (``keys``), on a frozen row order.

``Series`` sorts (keys, time, id) once; every metric is an aggregate over ordinals or a
window over overlapping blocks, so one very long series spreads over the cluster like
many short ones do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsight.functions.columns import micros_between, number
from tabsight.functions.moments import pairwise_corr
from tabsight.functions.tails import slope_p_value
from tabsight.operators.ordered import BLOCK, ORDINAL, Numbered, block_window, blocks, group_spans, number_rows
from tabsight.operators.quantiles import exact_quantiles, grouped_quantiles
from tabsight.sources.scratch import materialize

WINDOWS = (7, 30, 90)
PERIODS = (7, 30, 365)
YEAR_ROWS = 365
TRADING_DAYS = 252
MOMENTUM_STEPS = (5, 10, 20)
MAX_LAG = 20
VAR_LEVELS = (0.05, 0.01)
CHART_ROWS = 80
# Calendar labels in order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


class Series:
    """Rows with both a time and a value, ordered by (keys, time, id)."""

    def __init__(
        self, df: DataFrame, ts: str, value: str, ids: Sequence[str] = (), keys: Sequence[str] = (), block_size: int | None = None
    ):
        self.keys = list(keys)
        self.ids = [i for i in ids if i not in (*keys, ts, value)]
        self.block_size = block_size
        picked = [F.col(k) for k in self.keys] + [F.col(i) for i in self.ids]
        rows = df.select(*picked, F.col(ts).alias("ts"), number(df, value).alias("v"))
        self.rows = rows.filter(F.col("ts").isNotNull() & F.col("v").isNotNull())

    @cached_property
    def numbered(self) -> Numbered:
        return number_rows(self.rows, [*self.keys, "ts", *self.ids, "v"])

    @cached_property
    def spans(self) -> DataFrame:
        """(keys…, _start, _n): one row per series."""
        return group_spans(self.numbered, self.keys)

    def with_span(self, df: DataFrame) -> DataFrame:
        """Attach ``_start`` and ``_n`` of the row's series."""
        if not self.keys:
            return df.withColumn("_start", F.lit(0)).withColumn("_n", F.lit(self.numbered.total))
        return df.join(self.spans, self.keys)

    def windowed(self, before: int, **expressions) -> DataFrame:
        """Rows with window expressions that look back at most ``before`` rows in their series."""
        placed = blocks(self.numbered, before=before, size=self.block_size)
        w = block_window(self.keys)
        for name, build in expressions.items():
            placed = placed.withColumn(name, build(w))
        return placed.filter(~F.col("_halo")).drop("_halo")

    def with_previous(self) -> DataFrame:
        return self.windowed(1, prev=lambda w: F.lag("v").over(w), prev_ts=lambda w: F.lag("ts").over(w))


def _change(now: Column, then: Column) -> Column:
    return F.try_divide(now, then) - 1


def moving_average(s: Series, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(keys…, ids…, ts, v, ma_w…): trailing mean of w rows, null where the series is shorter than w."""
    means = {
        f"ma_{w}": (lambda win, w=w: F.avg("v").over(win.rowsBetween(-(w - 1), W.currentRow))) for w in windows
    }
    rows = s.with_span(s.windowed(max(windows) - 1, **means))
    gated = [F.when(F.col("_n") >= w, F.col(f"ma_{w}")).alias(f"ma_{w}") for w in windows]
    return rows.select(*s.keys, *s.ids, "ts", "v", ORDINAL, *gated)


def moving_average_summary(s: Series, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(keys…, window, current_value, change_from_start) for every window that fits the series."""
    rows = moving_average(s, windows)
    aggs = []
    for w in windows:
        aggs += [F.max_by(f"ma_{w}", ORDINAL).alias(f"last_{w}"), F.min_by(f"ma_{w}", ORDINAL).alias(f"first_{w}")]
    wide = rows.groupBy(*s.keys).agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(w).cast("bigint").alias("window"),
                F.col(f"last_{w}").alias("current_value"),
                (F.col(f"last_{w}") - F.col(f"first_{w}")).alias("change_from_start"),
            )
            for w in windows
        ]
    )
    return wide.select(*s.keys, F.inline(cells)).filter(F.col("current_value").isNotNull())


def growth(s: Series) -> DataFrame:
    """(keys…, mean, std, min, max) of period-over-period growth; a change from zero is left out."""
    g = s.with_previous().withColumn("g", _change(F.col("v"), F.col("prev")))
    return g.groupBy(*s.keys).agg(
        F.avg("g").alias("mean"), F.stddev_samp("g").alias("std"), F.min("g").alias("min"), F.max("g").alias("max")
    ).filter(F.col("mean").isNotNull())


def growth_yoy(s: Series, lag: int = YEAR_ROWS) -> DataFrame:
    """(keys…, mean, std, current) of growth over ``lag`` rows, for series longer than that."""
    rows = s.windowed(lag, then=lambda w: F.lag("v", lag).over(w))
    g = rows.withColumn("g", _change(F.col("v"), F.col("then"))).filter(F.col("g").isNotNull())
    return g.groupBy(*s.keys).agg(
        F.avg("g").alias("mean"), F.stddev_samp("g").alias("std"), F.max_by("g", ORDINAL).alias("current")
    ).filter(F.col("mean").isNotNull())


def linear_trend(s: Series) -> DataFrame:
    """OLS on the row number per series with at least three points.

    Slope and correlation do not change when row numbers are shifted, so the global ordinal
    serves directly; only the intercept is moved to the series' own first row.
    """
    x = F.col(ORDINAL).cast("double")
    sums = s.numbered.frame.groupBy(*s.keys).agg(
        F.count("*").alias("n"),
        F.min(x).alias("start"),
        F.regr_slope(F.col("v"), x).alias("slope"),
        pairwise_corr(F.col("v"), x).alias("r"),
        F.avg("v").alias("mean_v"),
        F.avg(x).alias("mean_x"),
        F.var_pop("v").alias("var_v"),
        F.var_pop(x).alias("var_x"),
    ).filter(F.col("n") >= 3)
    r = F.coalesce("r", F.lit(0.0))
    error = F.sqrt(F.greatest(F.lit(0.0), 1 - r * r) * F.col("var_v") / F.col("var_x") / (F.col("n") - 2))
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return sums.select(
        *s.keys,
        "n",
        "slope",
        (F.col("mean_v") - F.col("slope") * (F.col("mean_x") - F.col("start"))).alias("intercept"),
        (r * r).alias("r_squared"),
        error.alias("std_error"),
        direction.alias("trend_direction"),
        F.abs(r).alias("trend_strength"),
        slope_p_value(r, F.col("n").cast("double")).alias("p_value"),
    )


def seasonal_profile(s: Series, periods: Sequence[int] = PERIODS) -> DataFrame:
    """(keys…, period, phase, mean, std, min, max, count, cv) where two full cycles exist.

    Rows aggregate by ordinal modulo period, at most ``period`` rows per series; the phase is
    then turned to the series' own start on that small frame.
    """
    cells = F.array(
        *[F.struct(F.lit(p).cast("bigint").alias("period"), (F.col(ORDINAL) % p).alias("slot")) for p in periods]
    )
    rows = s.numbered.frame.select(*s.keys, "v", F.inline(cells))
    stats = rows.groupBy(*s.keys, "period", "slot").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count("*").alias("count"),
    )
    placed = s.with_span(stats).filter(F.col("_n") >= 2 * F.col("period"))
    phase = F.pmod(F.col("slot") - F.col("_start"), F.col("period"))
    return placed.select(
        *s.keys, "period", phase.alias("phase"), "mean", "std", "min", "max", "count",
        F.try_divide("std", "mean").alias("cv"),
    )


def seasonal_strength(s: Series, periods: Sequence[int] = PERIODS) -> DataFrame:
    """(keys…, period, strength): variance between phases against mean spread inside phases."""
    agg = seasonal_profile(s, periods).groupBy(*s.keys, "period").agg(
        F.var_samp("mean").alias("between"), F.avg("std").alias("spread")
    )
    within = F.col("spread") * F.col("spread")
    both = F.col("between") + within
    return agg.select(*s.keys, "period", F.when(both > 0, F.col("between") / both).otherwise(0.0).alias("strength"))


def _calendar(s: Series, slot: Column, labels: Sequence[str], minimum: int) -> DataFrame:
    """Mean, std and count per calendar slot; slots without rows appear with count 0."""
    rows = s.rows.withColumn("slot", slot.cast("bigint"))
    stats = rows.groupBy(*s.keys, "slot").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("count")
    )
    names = F.array(*[F.struct(F.lit(i).cast("bigint").alias("slot"), F.lit(n).alias("label")) for i, n in enumerate(labels)])
    sizes = stats.groupBy(*s.keys).agg(F.sum("count").alias("_n")).filter(F.col("_n") >= minimum)
    full = sizes.select(*s.keys, F.inline(names))
    return full.join(stats, [*s.keys, "slot"], "left").select(
        *s.keys, "slot", "label", "mean", "std", F.coalesce("count", F.lit(0).cast("bigint")).alias("count")
    )


def dow_profile(s: Series, minimum: int = 14) -> DataFrame:
    """(keys…, slot, label, mean, std, count) from Monday to Sunday."""
    return _calendar(s, F.weekday("ts"), WEEKDAYS, minimum)


def month_profile(s: Series, minimum: int = 24) -> DataFrame:
    """(keys…, slot, label, mean, std, count) from January to December."""
    return _calendar(s, F.month("ts") - 1, MONTHS, minimum)


def basic_metrics(s: Series) -> DataFrame:
    """(keys…, observations, first_ts, last_ts, range_days)."""
    micros = micros_between(F.col("first_ts"), F.col("last_ts"))
    spans = s.rows.groupBy(*s.keys).agg(
        F.count("*").alias("observations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return spans.withColumn("range_days", F.floor(micros / 86_400_000_000).cast("bigint"))


def frequency(s: Series) -> DataFrame:
    """(keys…, modal_gap_us, frequency) from the most common gap between consecutive times."""
    rows = s.with_previous().withColumn("gap", micros_between(F.col("prev_ts"), F.col("ts")))
    counts = rows.groupBy(*s.keys, "gap").agg(F.count("*").alias("n"))
    known = F.col("gap").isNotNull()
    modal = counts.groupBy(*s.keys).agg(
        F.min_by(F.when(known, F.col("gap")), F.when(known, F.struct(-F.col("n"), F.col("gap")))).alias("modal_gap_us")
    )
    hour = 3_600_000_000
    gap = F.col("modal_gap_us")
    label = (
        F.when(gap.isNull(), "unknown").when(gap <= hour, "hourly_or_less").when(gap <= 24 * hour, "daily")
        .when(gap <= 7 * 24 * hour, "weekly").when(gap <= 31 * 24 * hour, "monthly")
        .when(gap <= 365 * 24 * hour, "yearly").otherwise("irregular")
    )
    return modal.withColumn("frequency", label)


def returns(s: Series) -> DataFrame:
    """(keys…, ret): non-null period returns."""
    rows = s.with_previous().withColumn("ret", _change(F.col("v"), F.col("prev")))
    return rows.filter(F.col("ret").isNotNull()).select(*s.keys, "ret")


def volatility(s: Series, year: int = TRADING_DAYS) -> DataFrame:
    """(keys…, volatility, annualized, var_5pct, var_1pct) of the returns."""
    rets = materialize(returns(s), "returns")  # read by the spread and the quantiles
    spread = rets.groupBy(*s.keys).agg(F.count("*").alias("returns"), F.stddev_samp("ret").alias("volatility"))
    spread = spread.filter(F.col("returns") > 0)
    if s.keys:
        tails = grouped_quantiles(rets, s.keys, ["ret"], VAR_LEVELS)
        spread = spread.join(tails.select(*s.keys, "q"), s.keys)
        five, one = F.col("q")[0], F.col("q")[1]
    else:
        values = exact_quantiles(rets, ["ret"], VAR_LEVELS)["ret"]
        five, one = (F.lit(v).cast("double") for v in values)
    return spread.select(
        *s.keys, "volatility", (F.col("volatility") * F.sqrt(F.lit(float(year)))).alias("annualized_volatility"),
        five.alias("value_at_risk_5pct"), one.alias("value_at_risk_1pct"),
    )


def max_drawdown(s: Series) -> DataFrame:
    """(keys…, max_drawdown): lowest (v - running maximum) / running maximum.

    The running maximum inside a block is a window; blocks contribute one maximum each, whose
    running maximum over earlier blocks completes it.
    """
    placed = blocks(s.numbered, size=s.block_size).drop("_halo")
    peak = F.max("v").over(block_window(s.keys).rowsBetween(W.unboundedPreceding, W.currentRow))
    local = placed.withColumn("peak", peak)
    tops = placed.groupBy(BLOCK, *s.keys).agg(F.max("v").alias("top"))
    # blocks of one series: total rows / block size, so this window stays short
    earlier = W.partitionBy(*s.keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = tops.withColumn("carried", F.max("top").over(earlier)).select(BLOCK, *s.keys, "carried")
    full = local.join(carried, [BLOCK, *s.keys]).withColumn("peak", F.greatest("peak", "carried"))
    return full.groupBy(*s.keys).agg(F.min(F.try_divide(F.col("v") - F.col("peak"), F.col("peak"))).alias("max_drawdown"))


def momentum(s: Series, steps: Sequence[int] = MOMENTUM_STEPS, minimum: int = 10) -> DataFrame:
    """(keys…, step, momentum): last value against the value ``step`` rows from the end, that row counting as one.

    Only the last rows of each series travel: the row-number filter becomes a partial limit
    before the shuffle.
    """
    deepest = max(*steps, minimum)
    latest = [F.desc("ts"), *[F.desc(i) for i in s.ids], F.desc("v")]
    if s.keys:
        ranked = s.rows.withColumn("rn", F.row_number().over(W.partitionBy(*s.keys).orderBy(*latest)))
    else:
        newest = s.rows.orderBy(*latest).limit(deepest)
        ranked = newest.withColumn("rn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*latest)))
    tail = ranked.filter(F.col("rn") <= deepest)
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("v")))
    wide = tail.groupBy(*s.keys).agg(at(1).alias("last"), F.max("rn").alias("n"), *[at(k).alias(f"at_{k}") for k in steps])
    cells = F.array(
        *[
            F.struct(
                F.lit(k).cast("bigint").alias("step"),
                F.try_divide(F.col("last") - F.col(f"at_{k}"), F.col(f"at_{k}")).alias("momentum"),
                F.col(f"at_{k}").isNotNull().alias("reached"),
            )
            for k in steps
        ]
    )
    long = wide.filter(F.col("n") >= minimum).select(*s.keys, F.inline(cells))
    return long.filter("reached").drop("reached")


def autocorrelation(s: Series, max_lag: int = MAX_LAG, minimum: int = 10) -> DataFrame:
    """(keys…, lag, autocorr) for lags up to a quarter of the series; all lags in one pass."""
    lags = range(1, max_lag + 1)
    shifted = {f"lag_{k}": (lambda w, k=k: F.lag("v", k).over(w)) for k in lags}
    rows = s.windowed(max_lag, **shifted)
    cells = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"lag_{k}").alias("then")) for k in lags])
    long = rows.select(*s.keys, "v", F.inline(cells))
    # a lag of k rows leaves n - k pairs, so the series size follows from any lag's pairs
    found = long.groupBy(*s.keys, "lag").agg(
        F.count("then").alias("pairs"), pairwise_corr(F.col("v"), F.col("then")).alias("autocorr")
    )
    n = F.col("pairs") + F.col("lag")
    fits = (n >= minimum) & (F.col("lag") <= F.floor(n / 4))
    return found.filter((F.col("pairs") > 0) & fits & F.col("autocorr").isNotNull()).drop("pairs")


def minmax_level(s: Series, levels: int = 9, rows: int = CHART_ROWS) -> DataFrame:
    """(keys…, position, level): the first ``rows`` values scaled to 0…levels by the series' range."""
    first = s.with_span(s.numbered.frame).withColumn("position", F.col(ORDINAL) - F.col("_start"))
    span = s.rows.groupBy(*s.keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    head = first.filter(F.col("position") < rows)
    if s.keys:
        head = head.join(span, s.keys)
    else:
        low, high = span.first()
        head = head.withColumn("low", F.lit(low)).withColumn("high", F.lit(high))
    scaled = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * levels
    return head.select(*s.keys, "position", F.floor(scaled).cast("bigint").alias("level"))


def mean_position(stats: DataFrame, width: int = 70) -> DataFrame:
    """(column, mean_pos) from descriptive statistics: where the mean sits between min and max."""
    share = F.try_divide(F.col("mean") - F.col("min"), F.col("max") - F.col("min"))
    return stats.select("column", F.floor(share * width).cast("bigint").alias("mean_pos"))
