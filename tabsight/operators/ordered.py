"""Row order at scale: global ordinals, weighted positions and overlapping blocks.

A window without a partition key, or with one hot key, runs in a single task.  Here the
rows are range-partitioned by the full sort key (group keys, order columns, row id), so
neither a hot group nor a hot timestamp makes a partition large, and the order is frozen
in a written table.  Everything built on it is arithmetic on the ordinal:

* ``number_rows``   global 0-based ordinal of every row;
* ``cumulate``      total weight before every row (for value/count histograms);
* ``blocks``        equal-sized runs of ordinals, each with copies of its neighbours'
                    edge rows, so lags and trailing frames of bounded length run as
                    ordinary windows partitioned by (block, keys);
* ``rank_within``   row number and size per group without a per-group task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabsight.sources.scratch import materialize

ORDINAL = "_g"
BLOCK = "_block"
MIN_BLOCK_ROWS = 50_000
MAX_BLOCK_ROWS = 2_000_000

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position below


@dataclass(frozen=True)
class Numbered:
    """Rows in a frozen global order: column ``_g`` is the ordinal, ``total`` the row count."""

    frame: DataFrame
    total: int


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of partitions, for Python kernels per group.

    Run-time merging of small partitions looks at bytes; a kernel's time depends on its
    groups, so these partitions are kept apart.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _with_offsets(frozen: DataFrame, part: Column, weight: Column) -> tuple[DataFrame, int]:
    """Add ``_before``: total weight in earlier partitions (one small row per partition)."""
    spark = frozen.sparkSession
    sizes = frozen.groupBy(part.alias("_part")).agg(weight.alias("w")).orderBy("_part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total))
        total += row["w"]
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_before", T.LongType())])
    small = spark.createDataFrame(pd.DataFrame(offsets, columns=["_part", "_before"], dtype="int64"), schema)
    joined = frozen.withColumn("_part", part).join(F.broadcast(small), "_part").drop("_part")
    return joined, total


def number_rows(df: DataFrame, order_by: Sequence[str | Column]) -> Numbered:
    """Global ordinals in the order of ``order_by`` (end it with a unique id)."""
    cols = _order(order_by)
    frozen = materialize(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ordered",
    )
    joined, total = _with_offsets(frozen, F.shiftright("_mid", _POSITION_BITS), F.count("*"))
    position = F.col("_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return Numbered(joined.withColumn(ORDINAL, F.col("_before") + position).drop("_mid", "_before"), total)


def cumulate(df: DataFrame, order_by: Sequence[str | Column], weight: str) -> Numbered:
    """Column ``_g``: sum of ``weight`` over all rows that come before this one."""
    cols = _order(order_by)
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = ranged.withColumn("_pid", F.spark_partition_id().cast("long"))
    schema = T.StructType([*ranged.schema.fields, T.StructField("_run", T.LongType())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            weights = batch.column(batch.schema.get_field_index(weight)).cast(pa.int64())
            through = pc.add(pc.cumulative_sum(weights), carry)
            carry = through[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.subtract(through, weights)], names=[*batch.schema.names, "_run"])

    frozen = materialize(ranged.mapInArrow(running, schema), "cumulated")
    joined, total = _with_offsets(frozen, F.col("_pid"), F.sum(weight))
    return Numbered(joined.withColumn(ORDINAL, F.col("_before") + F.col("_run")).drop("_pid", "_run", "_before"), total)


def block_rows(total: int, reach: int, parallelism: int) -> int:
    """Rows per block: several blocks per task slot, within fixed memory bounds."""
    wanted = -(-total // max(1, 2 * parallelism))
    return max(4 * reach, 1, min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, wanted)))


def blocks(rows: Numbered, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Assign rows to blocks; ``_halo`` marks copies of the neighbouring blocks' edge rows.

    Each block holds the ``before`` rows ahead of it and the ``after`` rows behind it, so a
    window over (block, keys) ordered by ``_g`` sees every row a frame of that reach needs.
    """
    spark = rows.frame.sparkSession
    reach = max(before, after)
    if size is None:
        size = block_rows(rows.total, reach, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = max(size, reach, 1)
    own = F.expr(f"{ORDINAL} div {size}")
    inside = F.col(ORDINAL) % size
    targets = [own]
    if before:
        targets.append(F.when(inside >= size - before, own + 1))
    if after:
        targets.append(F.when((inside < after) & (own > 0), own - 1))
    if len(targets) == 1:
        return rows.frame.withColumn(BLOCK, own).withColumn("_halo", F.lit(False))
    placed = rows.frame.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets))))
    return placed.withColumn("_halo", F.col(BLOCK) != own)


def block_window(keys: Sequence[str]) -> W:
    """Window over one block of one series, in row order."""
    return W.partitionBy(BLOCK, *keys).orderBy(ORDINAL)


def group_spans(rows: Numbered, keys: Sequence[str]) -> DataFrame:
    """One row per group: first ordinal ``_start`` and size ``_n``.

    The table is written, so that joins to it are planned with its real size: few groups are
    broadcast without moving the rows, many groups are joined by a shuffle.
    """
    spans = rows.frame.groupBy(*keys).agg(F.min(ORDINAL).alias("_start"), F.count("*").alias("_n"))
    return materialize(spans, "spans")


def rank_within(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Add ``rank`` (1-based row number) and ``_n`` (group size) for each group of ``keys``.

    The group table joins back on the keys: broadcast when its size on disk is small, else
    shuffled, where adaptive execution splits a skewed key.
    """
    rows = number_rows(df, [*keys, *order_by])
    if not keys:
        return rows.frame.withColumn("rank", F.col(ORDINAL) + 1).withColumn("_n", F.lit(rows.total)).drop(ORDINAL)
    placed = rows.frame.join(group_spans(rows, keys), list(keys))
    return placed.withColumn("rank", F.col(ORDINAL) - F.col("_start") + 1).drop(ORDINAL, "_start")
