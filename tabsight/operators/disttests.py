"""Normality tests: Kolmogorov–Smirnov, D'Agostino K² and Shapiro–Wilk."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabsight.functions.moments import dagostino_k2
from tabsight.functions.tails import ks_p_value, normal_cdf
from tabsight.operators.ordered import ORDINAL, cumulate, spread
from tabsight.operators.quantiles import melt

MIN_ROWS = 8
DAGOSTINO_MIN_ROWS = 20
SHAPIRO_MAX_ROWS = 5000
TOO_LARGE = "more than 5000 values"

# Polynomial coefficients of Royston (1995), algorithm AS R94, constant term first.
_TAIL_1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_TAIL_2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def ks_normal(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, statistic, p_value) against the normal with the mean and sample std of the column (and group).

    Groups below eight values, or whose values do not vary or are not all finite, have no row; a null key is a
    group.  Values are counted and their counts cumulated over one global order, so neither a column nor
    a hot group is held in one task.
    """
    scope = [*keys, "column"]
    cells = melt(df, keys, columns)
    moments = cells.groupBy(*scope).agg(
        F.count("*").alias("_n"), F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"), F.max(F.abs("value")).alias("_most")
    ).filter((F.col("_n") >= MIN_ROWS) & (F.col("_std") > 0) & (F.col("_most") < F.lit(float("inf")))).drop("_most")
    counts = cells.groupBy(*scope, "value").agg(F.count("*").alias("n"))
    placed = cumulate(counts, [*scope, "value"], "n").frame
    starts = placed.groupBy(*scope).agg(F.min(ORDINAL).alias("_start"))
    known = starts.join(moments, [starts[c].eqNullSafe(moments[c]) for c in scope])
    known = known.select(*[starts[c].alias(f"_of_{c}") for c in scope], "_start", "_n", "_mean", "_std")
    met = placed.join(known, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in scope])
    met = met.withColumn("_cdf", normal_cdf((F.col("value") - F.col("_mean")) / F.col("_std")))
    before = (F.col(ORDINAL) - F.col("_start")) / F.col("_n")
    through = (F.col(ORDINAL) - F.col("_start") + F.col("n")) / F.col("_n")
    gap = F.greatest(through - F.col("_cdf"), F.col("_cdf") - before)
    found = met.groupBy(*scope).agg(F.max(gap).alias("statistic"), F.first("_n").alias("_n"))
    return found.select(*scope, "statistic", ks_p_value("statistic", "_n").alias("p_value"))


def dagostino(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, n, statistic, p_value) for at least twenty values that vary."""
    moments = melt(df, keys, columns).groupBy(*keys, "column").agg(
        F.count("*").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")
    )
    moments = moments.filter((F.col("n") >= DAGOSTINO_MIN_ROWS) & F.col("g1").isNotNull())
    k2, p = dagostino_k2(F.col("n"), F.col("g1"), F.col("g2"))
    return moments.select(*keys, "column", "n", k2.alias("statistic"), p.alias("p_value"))


def _poly(coefficients: Sequence[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


@lru_cache(maxsize=128)
def _normal_scores(n: int) -> np.ndarray:
    """Approximate expected order statistics of n standard normal values."""
    normal = NormalDist()
    return np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p-value for 3 to 5000 values, after Royston (1995)."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return (1.0, 1.0) if n >= 3 else (math.nan, math.nan)
    m = _normal_scores(n)
    mm = float(m @ m)
    weights = m / math.sqrt(mm)
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        u = 1.0 / math.sqrt(n)
        last = weights[-1] + _poly(_TAIL_1, u)
        if n > 5:
            second = weights[-2] + _poly(_TAIL_2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            inner = slice(2, n - 2)
        else:
            second = None
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            inner = slice(1, n - 1)
        weights[inner] = m[inner] / math.sqrt(phi)
        weights[0], weights[-1] = -last, last
        if second is not None:
            weights[1], weights[-2] = -second, second
    centred = x - x.mean()
    w = min(1.0, float(weights @ x) ** 2 / float(centred @ centred))
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    if w >= 1.0:
        return w, 1.0
    y, log_n = math.log(1.0 - w), math.log(n)
    if n <= 11:
        gamma = _poly(_GAMMA, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_LOG_SD, n))
    else:
        mean, sd = _poly(_LARGE_MEAN, log_n), math.exp(_poly(_LARGE_LOG_SD, log_n))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))


def shapiro_by_group(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, n, statistic, p_value, reason) for groups of at least 8 values.

    The test is not defined above 5000 values: such a group has its row with the reason and
    without a statistic.  Group sizes are counted before any rows are gathered, so a task
    never holds more than 5000 values.
    """
    scope = [*keys, "column"]
    cells = melt(df, keys, columns)
    sizes = cells.groupBy(*scope).agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_ROWS)
    rows = cells.join(sizes.filter(F.col("n") <= SHAPIRO_MAX_ROWS).select(*scope), scope, "left_semi")
    fields = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in scope) + ", n bigint, statistic double, p_value double"

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame([[*key, len(pdf), w, p]], columns=[*scope, "n", "statistic", "p_value"])

    tested = spread(rows, *scope).groupBy(*scope).applyInPandas(kernel, schema).withColumn("reason", F.lit(None).cast("string"))
    none = F.lit(None).cast("double")
    untested = sizes.filter(F.col("n") > SHAPIRO_MAX_ROWS).select(
        *scope, "n", none.alias("statistic"), none.alias("p_value"), F.lit(TOO_LARGE).alias("reason"))
    return tested.unionByName(untested)
