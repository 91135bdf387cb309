"""Rank correlations against brute force: ties, gaps and block recursion."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tabsight.operators import correlation


def tau_b(x, y):
    con = dis = tx = ty = 0
    for i, j in combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        con += a * b > 0
        dis += a * b < 0
        tx += a == 0
        ty += b == 0
    n0 = len(x) * (len(x) - 1) / 2
    return (con - dis) / np.sqrt((n0 - tx) * (n0 - ty))


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 400
    a = rng.integers(0, 12, n).astype(float)
    b = a + rng.normal(0, 5, n)
    c = np.where(rng.random(n) < 0.35, 3.0, rng.integers(0, 200, n).astype(float))  # one value holds a third of the rows
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    rows = pdf.astype(object).where(pdf.notna(), None)
    return pdf, spark.createDataFrame(rows, "a double, b double, c double").repartition(5)


def _found(df):
    return {(r["col1"], r["col2"]): r["corr"] for r in df.collect()}


def test_pearson_and_spearman_match_pandas(frame):
    pdf, df = frame
    pearson = _found(correlation.correlations(df, methods=["pearson"]))
    spearman = _found(correlation.correlations(df, methods=["spearman"]))
    ranks = {}
    for x, y in combinations("abc", 2):
        both = pdf[[x, y]].dropna()
        assert pearson[x, y] == pytest.approx(both[x].corr(both[y]))
        ranks[x, y] = both[x].rank().corr(both[y].rank())
        assert spearman[x, y] == pytest.approx(ranks[x, y])


@pytest.mark.parametrize("per_group", [1_000_000, 150, 40])
def test_kendall_by_blocks(frame, per_group):
    pdf, df = frame
    got = _found(correlation.kendall(df, ["a", "b", "c"], per_group=per_group))
    for x, y in combinations("abc", 2):
        both = pdf[[x, y]].dropna()
        assert got[x, y] == pytest.approx(tau_b(both[x].to_numpy(), both[y].to_numpy()))


@pytest.mark.parametrize("per_group, per_range", [(40, 1_000), (40, 20)])
def test_kendall_by_ranges_of_values(frame, monkeypatch, per_group, per_range):
    """Pairs of columns, with hot values or without, are counted without numbering the cells."""

    def numbered(*args):
        raise AssertionError("the cells were numbered")

    pdf, df = frame
    monkeypatch.setattr(correlation, "number_rows", numbered)
    got = _found(correlation.kendall(df, ["a", "b", "c"], per_group, per_range))
    for x, y in combinations("abc", 2):
        both = pdf[[x, y]].dropna()
        assert got[x, y] == pytest.approx(tau_b(both[x].to_numpy(), both[y].to_numpy()))


def test_kendall_with_too_many_cells_for_a_range(frame):
    pdf, df = frame
    got = _found(correlation.kendall(df, ["a", "b", "c"], per_group=150, per_value=0))
    for x, y in combinations("abc", 2):
        both = pdf[[x, y]].dropna()
        assert got[x, y] == pytest.approx(tau_b(both[x].to_numpy(), both[y].to_numpy()))


def test_discordant_weight_brute_force():
    rng = np.random.default_rng(3)
    a, b, w = rng.integers(0, 9, 80), rng.integers(0, 9, 80), rng.integers(1, 5, 80)
    want = sum(w[i] * w[j] for i in range(80) for j in range(80) if a[i] < a[j] and b[i] > b[j])
    assert correlation.discordant_weight(a, b, w) == want


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    for method in correlation.METHODS:
        value = correlation.correlations(df, methods=[method]).first()["corr"]
        assert value is None or np.isnan(value), method


def test_one_numeric_column_gives_nothing(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert correlation.correlations(df).count() == 0
    assert correlation.correlations(df, ["a", "b", "nope"], ["pearson", "unheard of"]).count() == 0


def test_bucket_edges(spark):
    df = spark.createDataFrame(
        [("pearson", "a", str(i), v) for i, v in enumerate([0.71, 0.7, 0.31, 0.3, 0.0, -0.3, -0.31, -0.7, -0.71])],
        "method string, col1 string, col2 string, corr double",
    )
    got = [r["bucket"] for r in correlation.bucket(df).orderBy("col2").collect()]
    assert got == ["++", "+", "+", "0", "0", "0", "-", "-", "--"]
