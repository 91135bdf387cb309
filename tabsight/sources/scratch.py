"""Intermediate tables kept in the folder the cluster names in ``spark.checkpoint.dir``.

Operators that need a frozen row order (see ``operators.ordered``) write one narrow
parquet table and read it back.  Parquet rather than an RDD checkpoint keeps column
pruning and size statistics for the plans built on top, and a lost executor costs a
re-read of the table instead of a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    created = tempfile.mkdtemp(prefix="tabsight-")
    spark.sparkContext.setCheckpointDir(created)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/tabsight/{app}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
