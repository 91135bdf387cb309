"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsight.sources.scratch import materialize, scratch_path  # noqa: F401  (one import place for the operators)

WORD_BREAKS = " \t\n\x0b\f\r"  # what separates words: [\x20\x09-\x0D]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column over the whole table."""
    return int(df.agg(F.sum(text_bytes(F.col(text)))).first()[0] or 0)


def tables(size: int, per_table: int, least: int = 1) -> int:
    """How many equal pieces keep each at about ``per_table``."""
    return max(least, -(-size // per_table))


def whole_id(doc_id: Column) -> list[Column]:
    """``doc_id`` and ``nameless`` for a pandas kernel: a null beside them would turn 64-bit ids into doubles."""
    number = doc_id.cast("long")
    return [F.coalesce(number, F.lit(0).cast("long")).alias("doc_id"), number.isNull().alias("nameless")]


def named_id() -> Column:
    """The id that ``whole_id`` has split."""
    return F.when(~F.col("nameless"), F.col("doc_id"))


def forget(*frames: DataFrame) -> None:
    """Delete written intermediate tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = hadoop(folder)
            if "/tabsight/" in folder:
                target.getFileSystem(conf).delete(target, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """While this holds, a finished step's shuffle files go at once, not when the driver's JVM next collects garbage.

    For steps whose results are written and read back, so that nothing needs their shuffles again.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise unsigned 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans(sizes: Iterable[int]) -> np.ndarray:
    """Start offsets of consecutive runs, with the total at the end."""
    return np.concatenate([[0], np.cumsum(np.asarray(list(sizes), dtype=np.int64))])


def frame(columns: dict) -> pd.DataFrame:
    return pd.DataFrame(columns)
