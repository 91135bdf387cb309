"""Run a stream over everything there is now, into a table of the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabsight.sources.scratch import scratch_path
from tabsight.streaming.states import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """The rows ``stream`` gives for the input present now; later ones stay in its state and are not returned."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        path = scratch_path(spark, label)
        writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        writer.option("checkpointLocation", scratch_path(spark, f"{label}-log")).start(path).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(path)
