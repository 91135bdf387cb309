"""Difference of two tables as multisets of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = 65_536  # the list of differing buckets is broadcast: at most this many numbers
_LOW = (1 << 32) - 1


def _canonical(df: DataFrame, column: str) -> Column:
    """The column with one zero and one NaN, so that equal values have equal digests."""
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.when(value == 0, F.lit(0.0)).when(F.isnan(value), F.lit(float("nan"))).otherwise(value)
    return value


def _digests(df: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """The columns with two 64-bit digests of the row and its bucket; where nulls stand goes into the digests."""
    cells = [_canonical(df, c) for c in columns]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    marked = df.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64(nulls, *cells).alias("_h1"), F.xxhash64(F.lit(1), *cells, nulls).alias("_h2"))
    return marked.withColumn("_bucket", F.pmod("_h1", F.lit(buckets)))


def _bucket_sums(rows: DataFrame) -> DataFrame:
    """Row count and sums of digest halves per bucket; sums count repeats and do not depend on order."""
    halves = []
    for h in ("_h1", "_h2"):
        halves += [F.sum(F.col(h).bitwiseAND(F.lit(_LOW))).alias(f"{h}_low"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"{h}_high")]
    sums = rows.groupBy("_bucket").agg(F.count("*").alias("_n"), *halves)
    return sums.select("_bucket", F.struct(*[c for c in sums.columns if c != "_bucket"]).alias("_sum"))


def table_diff(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(columns…, left_n, right_n): every row that one table holds more often than the other.

    Both tables are first reduced to a count and digest sums per bucket of rows; only rows of buckets that
    differ are shuffled and compared by their values.  Two tables whose buckets all agree are equal up to
    the odds of 128 digest bits.  Nulls equal nulls, NaN equals NaN, -0.0 equals 0.0; an empty table lacks
    every row.  The columns (all of the left table unless given) must have the same types on both sides.
    """
    columns = list(left.columns if columns is None else columns)
    clash = sorted({"left_n", "right_n", "_h1", "_h2", "_bucket"} & set(columns))
    if clash:
        raise ValueError(f"columns carry names of the result: {clash}")
    odd = [c for c in columns if left.schema[c].dataType != right.schema[c].dataType]
    if odd:
        raise ValueError(f"types differ: {odd}")
    a, b = _digests(left, columns, buckets), _digests(right, columns, buckets)
    theirs = _bucket_sums(b).withColumnRenamed("_sum", "_theirs")
    both = _bucket_sums(a).join(theirs, "_bucket", "full")
    differing = F.broadcast(both.filter(~F.col("_sum").eqNullSafe(F.col("_theirs"))).select("_bucket"))
    sided = [
        rows.join(differing, "_bucket", "left_semi").select(*[F.col(f"`{c}`") for c in columns], F.lit(l).alias("_l"), F.lit(r).alias("_r"))
        for rows, l, r in ((a, 1, 0), (b, 0, 1))
    ]
    counts = sided[0].unionByName(sided[1]).groupBy(*[F.col(f"`{c}`") for c in columns])
    counted = counts.agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))
    return counted.filter(F.col("left_n") != F.col("right_n"))
