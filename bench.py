"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tabsight.catalog import QUERIES
from tabsight.sources.scratch import release

HEADLINE = (
    "describe_wide", "describe_grouped", "agg_grouped", "agg_grouped_quantiles", "data_profile", "detect_types",
    "general_normalize", "validation_issues", "corr_pearson", "corr_spearman", "corr_kendall", "outliers_iqr",
    "outliers_modz", "outlier_consensus", "outliers_iforest", "outliers_lof", "moving_average", "moving_average_by_user",
    "growth_pop_by_user", "linear_trend", "seasonal_profile", "volatility_by_user", "max_drawdown", "autocorrelation",
    "dagostino", "shapiro_by_group", "priority_rank", "pareto_front", "criterion_rank", "state_duration",
    "validate_records", "extract_json", "targeted_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's engine
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    release(spark)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
