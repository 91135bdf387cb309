"""Stored profile states: merged equals one pass, moments equal brute force, sketches keep their bounds."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import stats, summaries


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(3000):
        part = "hot" if i % 3 else rng.choice(["a", "b", None])
        a = rng.gauss(5, 2) * 10 ** rng.randrange(-6, 7)
        b = None if rng.random() < 0.1 else rng.choice([float("nan"), 1.0, -2.5, 7.25])
        data.append((part, i % 4, a, b, rng.randrange(1000)))
    return data, spark.createDataFrame(data, "part string, day int, a double, b double, c long").repartition(7)


def bits(frame, keys):
    kept = [c for c in frame.columns if c not in ("kll", "hll")]
    return sorted((tuple(r) for r in frame.select(*kept).collect()), key=repr)


def test_merged_has_the_bits_of_one_pass(rows):
    _, df = rows
    once = summaries.summarize(df, ["a", "b", "c"])
    fine = summaries.summarize(df.repartition(3), ["a", "b", "c"], ["part", "day"])
    steps = summaries.merge(summaries.merge(fine, ["part"]))
    assert bits(summaries.merge(fine), []) == bits(once, []) == bits(steps, [])
    moments = ["column", "count", "mean", "std", "var", "skewness", "kurtosis"]
    one, many = (sorted(map(tuple, summaries.describe_state(s).select(*moments).collect())) for s in (once, steps))
    assert one == many


def test_sums_are_exact(rows):
    data, df = rows
    got = summaries.summarize(df, ["a"]).filter("power is not null").collect()
    for power, k in (("x", 1), ("xx", 2)):
        total = sum(Fraction(int(r["digits"])) * Fraction(2) ** (8 * r["band"] - 53) for r in got if r["power"] == power)
        assert total == sum(Fraction(v[2] if k == 1 else v[2] * v[2]) for v in data)


def test_parts_equal_the_statistics_of_their_rows(rows):
    _, df = rows
    names = ["b", "c"]
    state = summaries.merge(summaries.summarize(df, names, ["part", "day"]), ["part"])
    got = {(r["part"], r["column"]): r for r in summaries.describe_state(state, ["part"]).collect()}
    want = stats.scalar_stats(df, names, stats.SCALAR_STATS, ["part"]).collect()
    assert len(got) == len(want) == 8  # a null part is a part
    for r in want:
        mine = got[r["part"], r["column"]]
        assert (mine["count"], mine["min"], mine["max"]) == (r["count"], r["min"], r["max"])
        for s in ("mean", "std", "var", "skewness", "kurtosis"):
            assert math.isclose(mine[s], r[s], rel_tol=1e-9, abs_tol=1e-9)


def test_correlations_use_rows_with_both_values(rows):
    data, df = rows
    got = {(r["column"], r["other"]): r for r in summaries.correlate_state(summaries.summarize(df, ["a", "b", "c"], ["day"]).transform(summaries.merge)).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    both = [(r[3], float(r[4])) for r in data if r[3] is not None and r[3] == r[3]]
    assert got["b", "c"]["n"] == len(both)
    assert math.isclose(got["b", "c"]["pearson"], np.corrcoef(np.array(both).T)[0, 1], rel_tol=1e-9)


def test_sketches_keep_their_bounds_after_merging(spark):
    df = spark.range(0, 200_000, 1, 9).select((F.col("id") % 50).alias("part"), F.pmod(F.xxhash64("id"), F.lit(90_001)).alias("v"))
    state = summaries.merge(summaries.summarize(df, ["v"], ["part"], pairs=False))
    got = summaries.describe_state(state).first()
    values = np.sort(np.array([r["v"] for r in df.select("v").collect()]))
    for stat, prob in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        low, high = np.searchsorted(values, got[stat], "left") / len(values), np.searchsorted(values, got[stat], "right") / len(values)
        assert low - summaries.RANK_ERROR <= prob <= high + summaries.RANK_ERROR
    distinct = len(np.unique(values))
    assert abs(got["distinct"] - distinct) <= summaries.DISTINCT_ERROR * distinct


def test_batches_are_stored_once(spark, rows, tmp_path):
    _, df = rows
    path = str(tmp_path / "profile")
    for batch, chosen in (("one", "day < 2"), ("two", "day >= 2"), ("one", "day < 2")):  # the first is repeated
        summaries.store(summaries.summarize(df.filter(chosen), ["a", "c"], ["part"]), path, batch)
    whole = summaries.merge(summaries.summarize(df, ["a", "c"], ["part"]), ["part"])
    assert bits(summaries.stored(spark, path, ["part"]), ["part"]) == bits(whole, ["part"])
    with pytest.raises(ValueError):
        summaries.store(whole, path, "a/b")


def test_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1e200, 1.0, None), (-1e200, 1.0, None), (5e-324, 1.0, None), (-0.0, inf, None), (0.0, -inf, nan), (nan, None, nan)]
    df = spark.createDataFrame(data, "big double, flat double, none double")
    got = {r["column"]: r for r in summaries.describe_state(summaries.merge(summaries.summarize(df))).collect()}
    assert set(got) == {"big", "flat"}
    assert got["big"]["count"] == 5 and got["big"]["mean"] == 0.0 and got["big"]["std"] is None  # the squares overflow
    assert got["big"]["distinct"] == 4 and got["big"]["min"] == -1e200
    assert (got["flat"]["count"], got["flat"]["infinite"], got["flat"]["std"], got["flat"]["skewness"]) == (3, 2, 0.0, None)
    only = spark.createDataFrame([(inf,)], "v double")
    lone = summaries.describe_state(summaries.summarize(only)).first()
    assert (lone["count"], lone["infinite"], lone["mean"], lone["median"]) == (0, 1, None, None)


def test_empty_table_and_clashing_names(spark, rows):
    _, df = rows
    empty = summaries.summarize(df.limit(0), ["a", "b"], ["part"])
    assert summaries.merge(empty).count() == 0 and summaries.describe_state(summaries.merge(empty)).count() == 0
    assert summaries.correlate_state(summaries.merge(empty)).count() == 0
    with pytest.raises(ValueError):
        summaries.summarize(df.withColumnRenamed("part", "band"), ["a"], ["band"])
    with pytest.raises(ValueError):
        summaries.summarize(df, ["part"])


def test_products_are_built_from_plain_columns(spark):
    """One array of the products of all columns, each with its own test for missing values, ran interpreted."""
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "g int, a double, b double")
    plan = summaries.summarize(df, ["a", "b"], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate inline" in line]
    assert generated and not any("CASE WHEN" in line and " * " in line for line in generated)
