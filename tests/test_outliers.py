"""Outlier methods: gates, zero spread, block independence and planted extremes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import outliers


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(50, 5, 1500), rng.normal(200, 3, 500), [900.0, -400.0]])
    v[rng.random(len(v)) < 0.2] = 50.0  # a heavy tie
    v[-2:] = [900.0, -400.0]
    pdf = pd.DataFrame({"id": range(len(v)), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(4)


def _ids(flags, method):
    return {r["id"] for r in flags.filter(F.col("method") == method).collect()}


def test_threshold_methods_match_pandas(planted):
    pdf, df = planted
    flags = outliers.threshold_flags(df, ["id"], ["v"])
    v = pdf["v"]
    q1, q3 = v.quantile(0.25), v.quantile(0.75)
    want = pdf[(v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))]
    assert _ids(flags, "iqr") == set(want["id"])
    assert _ids(flags, "zscore") == set(pdf[((v - v.mean()) / v.std(ddof=0)).abs() > 3]["id"])
    assert _ids(flags, "percentile") == set(pdf[(v < v.quantile(0.05)) | (v > v.quantile(0.95))]["id"])
    mad = (v - v.median()).abs().median()
    assert _ids(flags, "modified_zscore") == set(pdf[(0.6745 * (v - v.median()) / mad).abs() > 3.5]["id"])


def test_no_spread_no_outliers(spark):
    df = spark.range(50).select("id", F.lit(3.0).alias("v"), F.lit(None).cast("double").alias("gone"))
    assert outliers.threshold_flags(df, ["id"], ["v", "gone"]).count() == 0


def lof_all_pairs(v, k):
    order = np.argsort(v, kind="stable")
    x = v[order]
    return order, outliers.lof_kernel(x, k)


def test_lof_kernel_against_definition():
    v = np.sort(np.random.default_rng(2).normal(0, 1, 60))
    k = 5
    d = np.abs(v[:, None] - v[None, :])
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(kd[nn], np.take_along_axis(d, nn, 1)).mean(1) + 1e-10)
    assert outliers.lof_kernel(v, k) == pytest.approx(lrd[nn].mean(1) / lrd)


def test_lof_does_not_depend_on_blocks(planted):
    pdf, df = planted
    whole = outliers.lof_scores(df, ["id"], "v", block_size=1_000_000).toPandas().set_index("id")["score"]
    split = outliers.lof_scores(df.repartition(7), ["id"], "v", block_size=150).toPandas().set_index("id")["score"]
    assert len(split) == len(pdf)
    assert split.sort_index().to_numpy() == pytest.approx(whole.sort_index().to_numpy())


def test_row_gates(spark):
    ten = spark.range(10).select("id", F.col("id").cast("double").alias("v"))
    assert outliers.forest_scores(ten, ["id"], "v") is None
    twenty = spark.range(20).select("id", F.col("id").cast("double").alias("v"))
    assert outliers.lof_scores(twenty, ["id"], "v") is None
    grid = outliers.method_grid(ten, ["v"], ["iqr", "isolation_forest", "lof"])
    assert [r["method"] for r in grid.collect()] == ["iqr"]


def test_forest_is_deterministic_and_finds_extremes(planted):
    pdf, df = planted
    scored = [outliers.forest_scores(d, ["id"], "v").toPandas().set_index("id")["score"].sort_index() for d in (df, df.repartition(9))]
    assert scored[0].to_numpy() == pytest.approx(scored[1].to_numpy())
    top = set(scored[0].nlargest(2).index)
    assert top == set(pdf["id"].iloc[-2:])
    flags = outliers.detect(df, ["id"], ["v"], ["isolation_forest"])
    assert 0 < flags.count() <= 0.1 * len(pdf) + 1
    assert top <= _ids(flags, "isolation_forest")


def test_trees_draw_from_the_whole_table(spark):
    df = spark.range(60_000).select("id", F.randn(4).alias("v"))
    drawn = outliers._tree_samples(df, ["id"], "v", 60_000, 40).toPandas()
    assert (drawn.groupby("tree").size() == outliers.TREE_ROWS).all()
    assert drawn["value"].nunique() > 0.9 * 60_000 * (1 - (1 - outliers.TREE_ROWS / 60_000) ** 40)  # nearly no value twice


def test_summary_keeps_methods_without_flags_and_consensus_counts(spark):
    df = spark.createDataFrame([(i, float(i % 5), 0.0 if i else 1000.0) for i in range(60)], "id int, flat double, spike double")
    methods = list(outliers.THRESHOLD_METHODS)
    flags = outliers.threshold_flags(df, ["id"], ["flat", "spike"], methods)
    summary = {(r["method"], r["column"]): r["count"] for r in outliers.summarize(flags, outliers.method_grid(df, ["flat", "spike"], methods)).collect()}
    assert summary["iqr", "flat"] == 0 and summary["iqr", "spike"] == 1 and len(summary) == 8
    agreed = outliers.consensus(flags, ["id"]).collect()
    assert [(r["column"], r["id"], r["agreement"]) for r in agreed] == [("spike", 0, 3)]  # MAD is 0, so three methods
    compared = {r["method"]: r for r in outliers.compare_methods(outliers.summarize(flags, outliers.method_grid(df, ["flat", "spike"], methods))).collect()}
    assert compared["modified_zscore"]["columns_processed"] == 2 and compared["modified_zscore"]["total_outliers"] == 0
