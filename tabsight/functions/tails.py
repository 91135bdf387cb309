"""Tail probabilities Spark SQL does not have, as vectorised helpers on small result frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t with ``df`` degrees of freedom."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def slope_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a regression slope from its correlation and the number of points."""

    def one(rv: float, nv: float) -> float | None:
        if pd.isna(rv) or pd.isna(nv) or nv < 3:
            return None
        if nv == 2 or abs(rv) >= 1.0:
            return 0.0
        return student_two_sided(rv * math.sqrt((nv - 2) / (1.0 - rv * rv)), nv - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """The standard normal distribution function."""
    return pd.Series([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in z.to_numpy(np.float64)], dtype="float64")


EXACT_KS = 1000  # sizes up to this have the exact distribution of the statistic


def _exact_ks(d: float, n: int) -> float:
    """P(D >= d) for n values: the matrix power of Marsaglia, Tsang and Wang (2003)."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i = np.arange(m)
    step = i[:, None] - i[None, :] + 1
    matrix = (step >= 0).astype(float)
    edge = h ** (i + 1.0)
    matrix[:, 0] -= edge
    matrix[-1, :] -= edge[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** m
    factorial = np.cumsum(np.log(np.arange(1, m + 1)))  # log of step!, from 1!
    matrix *= np.where(step > 0, np.exp(-factorial[np.maximum(step, 1) - 1]), 1.0)
    # result * 2^exponent is the product so far: scaled after each multiplication
    result, exponent, base, base_exponent, left = np.eye(m), 0, matrix, 0, n
    while left:
        if left & 1:
            result, exponent = result @ base, exponent + base_exponent
            shift = math.frexp(float(np.abs(result).max()))[1]
            result, exponent = result * 2.0**-shift, exponent + shift
        base, base_exponent, left = base @ base, 2 * base_exponent, left >> 1
        shift = math.frexp(float(np.abs(base).max()))[1]
        base, base_exponent = base * 2.0**-shift, base_exponent + shift
    centre = float(result[k - 1, k - 1])
    if centre <= 0.0:
        return 1.0
    log_below = math.log(centre) + exponent * math.log(2.0) + math.lgamma(n + 1) - n * math.log(n)
    return min(1.0, max(0.0, -math.expm1(log_below)))


def ks_two_sided(d: float, n: int) -> float:
    """P(D >= d) of the one-sample Kolmogorov-Smirnov statistic.

    Exact up to 1,000 values unless the tail is below 1e-15; beyond, the limit distribution with the correction
    of Vrbik (2018), whose error falls with n to the power of -3/2.
    """
    if d <= 0.0:
        return 1.0
    if d >= 1.0:
        return 0.0
    if n <= EXACT_KS and n * d * d < 18.0:
        return _exact_ks(d, n)
    root = math.sqrt(n)
    x = d * root
    x += 1.0 / (6.0 * root) + (x - 1.0) / (4.0 * n)
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * x * x) for j in range(1, 40))
    return min(1.0, max(0.0, 2.0 * total))


@F.pandas_udf(T.DoubleType())
def ks_p_value(d: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of the Kolmogorov-Smirnov statistic of n values; n may exceed 32 bits."""
    return pd.Series([ks_two_sided(float(a), int(b)) for a, b in zip(d, n)], dtype="float64")
