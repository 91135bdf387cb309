"""Moment-based statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness G1; null below 3 values or without variation."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2; null below 4 values or without variation."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def pairwise_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present; null without variation.

    (The built-in ``corr`` divides by zero on a constant side, which ANSI mode reports as an error.)
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def variation(std: Column, mean: Column) -> Column:
    """Coefficient of variation; 0 for a zero mean."""
    return F.when(mean == 0, F.lit(0.0)).otherwise(std / mean)


def dagostino_k2(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """D'Agostino–Pearson omnibus test from the size and population skewness / excess kurtosis.

    Returns (K², p); D'Agostino (1970) for the skewness part, Anscombe & Glynn (1983) for
    the kurtosis part.  p is the chi-square tail with two degrees of freedom.
    """
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)

    expected = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - expected) / F.sqrt(spread)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    ratio = F.try_divide(1 - 2 / a, denominator)
    z2 = (1 - 2 / (9 * a) - F.signum(ratio) * F.cbrt(F.abs(ratio))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, F.exp(-k2 / 2)
