"""Descriptive statistics, quantiles and aggregations on hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import quantiles, stats


@pytest.fixture(scope="module")
def frame(spark):
    pdf = pd.DataFrame(
        {
            "g": ["a"] * 6 + ["b"] * 4 + [None] * 2,
            "x": [3.0, 1.0, 1.0, 7.0, None, 3.0, 2.0, 2.0, 9.0, 4.0, 5.0, None],
            "same": [4.0] * 12,
            "gone": [None] * 12,
            "label": list("abcdefghijkl"),
        }
    )
    schema = "g string, x double, same double, gone double, label string"
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


def test_describe_matches_pandas(frame):
    pdf, df = frame
    got = {r["column"]: r for r in stats.describe(df).collect()}
    assert set(got) == {"x", "same"}  # text is skipped, the empty column has no statistics
    x, r = pdf["x"].dropna(), got["x"]
    assert r["count"] == len(x)
    for stat, want in {
        "mean": x.mean(), "median": x.median(), "std": x.std(), "var": x.var(), "min": x.min(), "max": x.max(),
        "skewness": x.skew(), "kurtosis": x.kurtosis(), "q25": x.quantile(0.25), "q75": x.quantile(0.75),
    }.items():
        assert r[stat] == pytest.approx(want), stat
    assert r["mode"] == 1.0 and r["mode_count"] == 2  # 1, 2 and 3 all appear twice
    assert got["same"]["std"] == 0 and got["same"]["skewness"] is None


def test_small_groups_have_no_higher_moments(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (2, 2.0), (3, 1.0), (3, 2.0), (3, 4.0)], "k int, v double")
    got = {r["k"]: r for r in stats.describe(df, ["v"], keys=["k"]).collect()}
    assert got[1]["std"] is None and got[2]["std"] is not None
    assert got[2]["skewness"] is None and got[3]["skewness"] is not None
    assert got[3]["kurtosis"] is None


def test_aggregate_drops_null_groups_and_sums_nothing_to_zero(frame):
    _, df = frame
    got = {(r["g"], r["column"]): r for r in stats.aggregate(df, group_by="g").collect()}
    assert {g for g, _ in got} == {"a", "b"}
    assert got["a", "gone"]["sum"] == 0 and got["a", "gone"]["count"] == 0 and got["a", "gone"]["mean"] is None
    assert got["b", "x"]["median"] == 3.0 and got["b", "x"]["q90"] == pytest.approx(7.5)


def test_aggregate_single_method(frame):
    _, df = frame
    out = stats.aggregate(df, ["x"], methods=["median"])
    assert out.columns == ["column", "median"] and out.first()["median"] == 3.0


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    smooth, lumpy = rng.exponential(10, 5000), rng.integers(0, 4, 5000).astype(float)
    lumpy[rng.random(5000) < 0.4] = 2.0
    pdf = pd.DataFrame({"k": np.where(rng.random(5000) < 0.6, 1, rng.integers(2, 9, 5000)), "smooth": smooth, "lumpy": lumpy})
    return pdf, spark.createDataFrame(pdf).repartition(6)


@pytest.mark.parametrize("limit", [4_000_000, 300, 1])
def test_exact_quantiles_by_narrowing(numbers, limit):
    pdf, df = numbers
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["smooth", "lumpy"], probs, direct_rows=limit)
    for c in ("smooth", "lumpy"):
        assert got[c] == pytest.approx([pdf[c].quantile(q) for q in probs], rel=1e-12)


def test_coarse_sketch_still_gives_exact_values(numbers, monkeypatch):
    pdf, df = numbers
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 20)
    got = quantiles.exact_quantiles(df, ["smooth"], [0.1, 0.5], direct_rows=100)["smooth"]
    assert got == pytest.approx([pdf["smooth"].quantile(q) for q in (0.1, 0.5)], rel=1e-12)


@pytest.mark.parametrize("limit", [4_000_000, 1000, 1])
def test_grouped_quantiles_with_hot_group(numbers, limit):
    pdf, df = numbers
    got = quantiles.grouped_quantiles(df, ["k"], ["smooth", "lumpy"], [0.25, 0.5, 0.99], direct_rows=limit)
    rows = {(r["k"], r["column"]): r["q"] for r in got.collect()}
    assert len(rows) == 2 * pdf["k"].nunique()
    for (k, c), q in rows.items():
        assert q == pytest.approx([pdf.loc[pdf["k"] == k, c].quantile(p) for p in (0.25, 0.5, 0.99)], rel=1e-12)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert stats.describe(df).count() == 0
    assert quantiles.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_repartitioning_changes_nothing(numbers):
    _, df = numbers
    a = stats.describe(df).orderBy("column").toPandas()
    b = stats.describe(df.repartition(3).orderBy(F.desc("smooth"))).orderBy("column").toPandas()
    for c in a.columns:
        for u, v in zip(a[c], b[c]):
            assert u == v or math.isclose(u, v, rel_tol=1e-9)


def test_counts_of_values_keep_their_partitions(spark):
    """Merged by compressed bytes, all values of a group met in few tasks."""
    df = spark.range(4000).select(F.lit("a").alias("g"), (F.col("id") % 2000).cast("double").alias("x"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    counts = quantiles.value_counts(quantiles.melt(df, ["g"], ["x"]), ["g", "column"])
    assert len(counts.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == before
    assert counts.count() == 2000 and {r["n"] for r in counts.collect()} == {2}
    got = quantiles.grouped_quantiles(df, ["g"], ["x"], [0.5], direct_rows=10).first()
    assert got["q"] == [999.5]


def test_large_groups_are_counted_in_many_tasks(spark, monkeypatch):
    """A join by key put each large group whole into one task."""
    seen = []
    monkeypatch.setattr(quantiles, "_histogram_by_group", lambda rows, keys, columns, probs: seen.append(rows) or real(rows, keys, columns, probs))
    df = spark.range(9000).select(F.when(F.col("id") % 9 > 0, "a").otherwise("b").alias("g"), (F.col("id") % 100).cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["g"]: r["q"] for r in quantiles.grouped_quantiles(df, ["g"], ["x"], [0.5], direct_rows=2000).collect()}
        assert len(got) == 2 and seen[0].withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quantiles_of_few_groups_do_not_shuffle_their_values(spark):
    """Joined by group with its place in the order, all values of a group met in one task."""
    counts = spark.range(6000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    got = quantiles.quantiles_of_counts(counts, ["g"], [0.5])
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["g"]: r["q"] for r in got.collect()} == {0: [2999.0], 1: [3000.0]}


real = quantiles._histogram_by_group
