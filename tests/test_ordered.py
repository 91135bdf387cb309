"""Ordinals, weighted positions, blocks and ranks against plain windows, skew included."""

import pytest
from pyspark.sql import Window as W, functions as F

from tabsight.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    # key 0 holds two thirds of the rows and one timestamp is shared by a third of them
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 3 == 0, 500).otherwise((F.col("id") * 7919) % 1000).alias("t"),
        ((F.col("id") * 104729) % 997).cast("double").alias("v"),
    ).repartition(5)


def test_ordinals_follow_the_sort_order(skewed):
    rows = ordered.number_rows(skewed, ["k", "t", "id"])
    assert rows.total == 3000
    want = F.row_number().over(W.orderBy("k", "t", "id")) - 1
    assert rows.frame.withColumn("want", want).filter("want <> _g").count() == 0


def test_hot_key_and_hot_time_spread_over_partitions(spark, skewed):
    # small inputs are merged into one partition at run time, so keep them apart here
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ordered.number_rows(skewed, ["k", "t", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    frozen = spark.read.parquet(*rows.frame.inputFiles())
    files = frozen.select("k", "t", F.col("_metadata.file_path").alias("p"))
    assert files.filter("k = 0").select("p").distinct().count() > 2
    assert files.filter("k = 0 AND t = 500").select("p").distinct().count() > 1


@pytest.mark.parametrize("size", [8, 50, 777, 100_000])
def test_blocks_reproduce_trailing_windows(skewed, size):
    rows = ordered.number_rows(skewed, ["k", "t", "id"])
    placed = ordered.blocks(rows, before=6, after=2, size=size)
    w = ordered.block_window(["k"])
    got = placed.withColumn("ma", F.avg("v").over(w.rowsBetween(-6, 0))).withColumn("ahead", F.lead("v", 2).over(w))
    got = got.filter("NOT _halo").select("id", "ma", "ahead")
    plain = W.partitionBy("k").orderBy("t", "id")
    want = skewed.select(
        "id", F.avg("v").over(plain.rowsBetween(-6, 0)).alias("ma2"), F.lead("v", 2).over(plain).alias("ahead2")
    )
    both = got.join(want, "id")
    assert both.count() == 3000
    assert both.filter("abs(ma - ma2) > 1e-9 OR NOT ahead <=> ahead2").count() == 0


def test_cumulated_weights(skewed):
    counts = skewed.groupBy("t").agg(F.count("*").alias("n"))
    placed = ordered.cumulate(counts, ["t"], "n")
    assert placed.total == 3000
    want = F.coalesce(F.sum("n").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    assert placed.frame.withColumn("want", want).filter("want <> _g").count() == 0


def test_rank_within_descending(skewed):
    got = ordered.rank_within(skewed, ["k"], [F.col("v").desc(), F.col("id")])
    want = F.row_number().over(W.partitionBy("k").orderBy(F.col("v").desc(), "id"))
    size = F.count("*").over(W.partitionBy("k"))
    assert got.withColumn("want", want).withColumn("size", size).filter("want <> rank OR size <> _n").count() == 0


def test_scratch_folder_comes_from_the_session(spark):
    from tabsight.sources.scratch import materialize, release, scratch_dir

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_dir(spark) == configured.rstrip("/")
    table = materialize(spark.range(5), "check")
    assert scratch_dir(spark) in table.inputFiles()[0] and table.count() == 5
    assert release(spark) >= 1
    assert release(spark) == 0
