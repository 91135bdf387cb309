"""Normality tests against published examples and closed forms."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions import tails
from tabsight.operators import disttests


def test_shapiro_published_examples():
    # men's weights, a standard worked example
    w, p = disttests.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.7888, abs=2e-4) and p == pytest.approx(0.0067, abs=2e-4)


def test_shapiro_rejects_exponential_and_keeps_normal():
    rng = np.random.default_rng(1)
    keep = [disttests.shapiro_wilk(rng.normal(3, 2, n))[1] for n in (8, 11, 12, 50, 400) for _ in range(60)]
    assert 0.01 < np.mean(np.array(keep) < 0.05) < 0.1
    assert disttests.shapiro_wilk(rng.exponential(1, 200))[1] < 1e-8
    assert disttests.shapiro_wilk(np.full(10, 2.0)) == (1.0, 1.0)


def test_shapiro_groups_are_bounded(spark):
    df = spark.range(5020).select(
        F.when(F.col("id") < 5001, "big").when(F.col("id") < 5008, "small").otherwise("fits").alias("g"),
        F.randn(3).alias("v"),
    )
    got = disttests.shapiro_by_group(df, ["v"], ["g"]).collect()
    assert sorted((r["g"], r["n"], r["statistic"] is None, r["reason"]) for r in got) == [
        ("big", 5001, True, disttests.TOO_LARGE), ("fits", 12, False, None)]


def test_ks_statistic(spark):
    v = np.random.default_rng(6).exponential(2, 300)
    got = disttests.ks_normal(spark.createDataFrame(pd.DataFrame({"v": v})), ["v"]).first()
    z = NormalDist(v.mean(), v.std(ddof=1))
    cdf = np.array([z.cdf(x) for x in np.sort(v)])
    want = max((np.arange(1, 301) / 300 - cdf).max(), (cdf - np.arange(300) / 300).max())
    assert got["statistic"] == pytest.approx(want) and got["p_value"] < 1e-4


@pytest.mark.parametrize(("n", "d", "below"), [(10, 0.274, 0.6284796154565), (1, 0.75, 0.5), (2, 0.5, 0.5)])
def test_ks_tail_known_values(n, d, below):
    assert tails.ks_two_sided(d, n) == pytest.approx(1 - below, abs=1e-12)


@pytest.mark.parametrize("x", [0.5, 0.8, 1.2, 1.7, 2.2])
def test_ks_tail_beyond_the_exact_sizes(x):
    n = 4000
    d = x / math.sqrt(n)
    assert tails.ks_two_sided(d, n) == pytest.approx(tails._exact_ks(d, n), abs=2e-5)
    big = 1 << 40
    limit = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 30))
    assert tails.ks_two_sided(x / math.sqrt(big), big) == pytest.approx(limit, abs=1e-5)


def test_ks_by_group_with_a_hot_group_and_odd_values(spark):
    rng = np.random.default_rng(8)
    groups = ["hot"] * 900 + ["b"] * 60 + [None] * 40 + ["flat"] * 9 + ["two"] * 2 + ["inf"] * 9
    values = list(np.round(rng.normal(3, 2, 1000), 1)) + [4.0] * 9 + [1.0, 2.0] + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, math.inf]
    rows = [(g, float(v)) for g, v in zip(groups, values)] + [("b", None), ("b", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in disttests.ks_normal(df, ["v"], ["g"]).collect()}
    assert set(got) == {"hot", "b", None}
    for g in got:
        v = np.sort([b for a, b in zip(groups, values) if a == g])
        cdf = np.array([NormalDist(v.mean(), v.std(ddof=1)).cdf(x) for x in v])
        want = max((np.arange(1, len(v) + 1) / len(v) - cdf).max(), (cdf - np.arange(len(v)) / len(v)).max())
        assert got[g]["statistic"] == pytest.approx(want, abs=1e-12)
        assert got[g]["p_value"] == pytest.approx(tails.ks_two_sided(want, len(v)), abs=1e-9)
    assert disttests.ks_normal(df.limit(0), ["v"], ["g"]).count() == 0


def test_dagostino_size_gate_and_level(spark):
    df = spark.range(20000).select((F.col("id") % 400).alias("g"), F.randn(12).alias("v"))
    got = disttests.dagostino(df, ["v"], ["g"]).toPandas()
    assert len(got) == 400 and (got["n"] == 50).all()
    assert 0.02 < (got["p_value"] < 0.05).mean() < 0.1
    assert (got["p_value"] - np.exp(-got["statistic"] / 2)).abs().max() < 1e-12
    assert disttests.dagostino(df.filter("id < 19"), ["v"]).count() == 0 if "id" in df.columns else True
    flat = spark.range(30).select(F.lit(1.0).alias("v"))
    assert disttests.dagostino(flat, ["v"]).count() == 0
    assert not math.isnan(got["statistic"].mean())
