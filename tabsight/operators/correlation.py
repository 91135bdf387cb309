"""Pearson, Spearman and Kendall matrices in long form (method, col1, col2, corr)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabsight.functions.columns import numeric_columns, select_numeric
from tabsight.functions.moments import pairwise_corr
from tabsight.operators.ordered import ORDINAL, cumulate, number_rows, spread
from tabsight.operators.quantiles import melt
from tabsight.sources.scratch import materialize

METHODS = ("pearson", "spearman", "kendall")
STRONG = 0.7
POINTS_PER_GROUP = 50_000  # more distinct points are counted block by block, in many tasks
POINTS_PER_RANGE = 500_000  # points that a range of values holds on average
POINTS_PER_VALUE = 200_000  # a value with more points is not kept in one range
_PAIR_SCHEMA = "method string, col1 string, col2 string, corr double"


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs, each over its rows without nulls, in one scan.

    Rows fan out to (pair, x, y) inside the scan stage and are aggregated there, so one row
    per pair and task is shuffled.  A wide aggregate with one correlation per pair outgrows
    what the JVM compiles and runs interpreted.
    """
    pairs = list(combinations(columns, 2))
    cells = F.array(
        *[F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)]
    )
    long = df.select(F.inline(cells)).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    names = df.sparkSession.createDataFrame(
        [(i, "pearson", a, b) for i, (a, b) in enumerate(pairs)], "pair int, method string, col1 string, col2 string"
    )
    found = long.groupBy("pair").agg(pairwise_corr(F.col("x"), F.col("y")).alias("corr"))
    return names.join(found, "pair", "left").drop("pair")


def centred_ranks(counts: DataFrame, value: str) -> DataFrame:
    """(value, rank) from a (value, n) histogram: tied values share the mean of their ranks.

    Ranks are shifted by their overall mean (total + 1) / 2, which keeps the sums small.
    """
    placed = cumulate(counts, [value], "n")
    rank = F.col(ORDINAL) + (F.col("n") + 1) / 2.0 - (placed.total + 1) / 2.0
    return placed.frame.select(value, rank.alias("rank"))


def _spearman_complete(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """Pairs of columns without nulls: one shared ranking per column, then one aggregate for all pairs.

    The histograms of all columns are ranked in one sorted table; column number j starts at
    j·rows because every column contributes each row once.  Each column's ranks are written, so
    that a column with few values is planned as a broadcast and does not move the rows.
    """
    counts = melt(df, [], columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = cumulate(counts, ["column", "value"], "n").frame
    ranked = df.select(*columns)
    for j, c in enumerate(sorted(columns)):
        rank = F.col(ORDINAL) - F.lit(j * rows) + (F.col("n") + 1) / 2.0 - (rows + 1) / 2.0
        ranks = placed.filter(F.col("column") == c).select(F.col("value").alias(c), rank.alias(f"{c}__rank"))
        ranked = ranked.join(materialize(ranks, "ranks"), c)
    pairs = pearson(ranked.select(*[F.col(f"{c}__rank").alias(c) for c in columns]), columns)
    return pairs.withColumn("method", F.lit("spearman"))


def _spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """One pair on its complete rows, reduced to distinct (x, y) with counts.

    Ranks of y join on y and collapse to one weighted sum per x; ranks of x then meet a table
    unique in x, so only the first join can see a hot key, and adaptive execution splits it.
    """
    cells = df.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    cells = materialize(cells.groupBy("x", "y").agg(F.count("*").alias("n")), "pairs")
    rx = centred_ranks(cells.groupBy("x").agg(F.sum("n").alias("n")), "x").withColumnRenamed("rank", "rx")
    ry = centred_ranks(cells.groupBy("y").agg(F.sum("n").alias("n")), "y").withColumnRenamed("rank", "ry")
    by_x = cells.join(ry, "y").groupBy("x").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("ry")).alias("sy"),
        F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("syy"),
    )
    sums = by_x.join(rx, "x").agg(
        F.sum(F.col("rx") * F.col("sy")).alias("sxy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum("syy").alias("syy"),
    )
    return sums.select(
        F.lit("spearman").alias("method"),
        F.lit(a).alias("col1"),
        F.lit(b).alias("col2"),
        F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy")).alias("corr"),
    )


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of average ranks, each pair on its complete rows."""
    row = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    complete = [c for i, c in enumerate(columns) if row[f"n{i}"] == row["rows"] > 0]
    out = _spearman_complete(df, complete, row["rows"]) if len(complete) > 1 else None
    for a, b in combinations(columns, 2):
        if a in complete and b in complete:
            continue
        pair = _spearman_pair(df, a, b)
        out = pair if out is None else out.unionByName(pair)
    return out


def discordant_weight(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i·w_j over pairs with a_i < a_j and b_i > b_j (both strict), in O(n log n).

    Points are put in (a, b) order, where ties of a cannot count; the pairs are then found
    digit by digit on the rank of b, each pair at the highest bit in which the ranks differ.
    """
    if len(a) < 2:
        return 0.0
    order = np.lexsort((b, a))
    rank = np.unique(b[order], return_inverse=True)[1].astype(np.int64)
    weight = w[order].astype(np.float64)
    total = 0.0
    for bit in range(int(rank.max()).bit_length()):
        prefix = rank >> (bit + 1)
        by_prefix = np.argsort(prefix, kind="stable")
        p, high = prefix[by_prefix], ((rank >> bit) & 1)[by_prefix].astype(bool)
        wt = weight[by_prefix]
        ahead = np.cumsum(np.where(high, wt, 0.0))
        first = np.searchsorted(p, p, side="left")
        base = np.where(first > 0, ahead[first - 1], 0.0)
        low = ~high
        total += float(np.sum(wt[low] * (ahead[low] - base[low])))
    return total


def _count_within(points: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Discordant weight inside each group; groups are bounded by the choice of block widths."""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [discordant_weight(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy())]})

    rows = points.select(F.col(group).alias("grp"), F.col(a).alias("a"), F.col(b).alias("b"), "w")
    return spread(rows, "grp").groupBy("grp").applyInPandas(kernel, "d double").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))


def discordant_pairs(points: DataFrame, size: int, per_group: int = POINTS_PER_GROUP) -> float:
    """Weighted discordant pairs of points (a, b, w) with a and b in 0…size-1, each used once.

    Both axes are cut into blocks.  A pair lies in one a-block, or in one b-block but two
    a-blocks, or differs in both: the first two kinds are counted inside bounded groups, the
    third is the same problem on the much smaller grid of block pairs, so the loop repeats
    until a grid fits one group.
    """
    return _count_blocks(points, size, size, 1, 1, per_group)


def _count_blocks(points: DataFrame, a_values: int, b_values: int, per_a: int, per_b: int, per_group: int) -> float:
    """The loop of ``discordant_pairs``: at most ``per_a`` points share one of ``a_values`` values of a, and so for b."""
    total = 0.0
    while True:
        if min(a_values * per_a, b_values * per_b) <= per_group:
            whole = points.withColumn("one", F.lit(1))
            return total + _count_within(whole, "one", "a", "b").first()["d"]
        a_width, b_width = max(1, per_group // per_a), max(1, per_group // per_b)
        placed = points.withColumn("ab", F.expr(f"a div {a_width}")).withColumn("bb", F.expr(f"b div {b_width}"))
        total += _count_within(placed, "ab", "a", "b").first()["d"]
        total += _count_within(placed, "bb", "ab", "b").first()["d"]
        grid = placed.groupBy(F.col("ab").alias("a"), F.col("bb").alias("b")).agg(F.sum("w").alias("w"))
        points = materialize(grid, "grid")
        a_values, b_values = -(-a_values // a_width), -(-b_values // b_width)
        per_a, per_b = b_values, a_values


def _count_ranges(points: DataFrame, a: str, b: str, ranges: int) -> tuple[float, DataFrame]:
    """Discordant weight of the pairs within each range of a, and the points (range, b, w) that hold the other pairs.

    Equal values of a are in one range, so points of two ranges differ in a as their ranges do.
    """
    schema = "d double, rng int, b double, w double"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False), x.column(2).to_numpy(zero_copy_only=False))
               for x in batches if x.num_rows]
        if not got:
            return
        xs, ys, ws = (np.concatenate(c) for c in zip(*got))
        values, place = np.unique(ys, return_inverse=True)
        weights = np.bincount(place, weights=ws)
        d = np.zeros(len(values))
        d[0] = discordant_weight(xs, place, ws)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d), pa.array(np.full(len(values), TaskContext.get().partitionId(), dtype=np.int32)), pa.array(values.astype(float)), pa.array(weights)],
            names=["d", "rng", "b", "w"])

    rows = points.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col("w").cast("double").alias("w"))
    counted = materialize(rows.repartitionByRange(ranges, "a").mapInArrow(kernel, schema), "ranges")
    return counted.agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0], counted.select("rng", "b", "w")


def _discordant_by_values(cells: DataFrame, a: str, b: str, distinct: int, per_range: int, per_group: int) -> float:
    """Discordant weight of distinct cells of which few share a value of a.

    Pairs are counted within ranges of a, then, in different ranges of a, within ranges of b, where a value
    has one point per range of a; the others lie on the grid of both ranges.
    """
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = lambda n: max(1, min(tasks, -(-n // per_group)), -(-n // per_range))
    wide = ranges(distinct)
    inside, rest = _count_ranges(cells, a, b, wide)
    tall = ranges(rest.count())
    across, grid = _count_ranges(rest, "b", "rng", tall)
    # a grid point: (range of b, range of a as a number)
    points = grid.select(F.col("b").cast("long").alias("a"), F.col("rng").cast("long").alias("b"), "w")
    return inside + across + _count_blocks(points, tall, wide, wide, tall, per_group)


def _tie_counts(cells: DataFrame) -> tuple[float, float, float, float, int, int]:
    """(all pairs, pairs tied in x, in y, in both, most cells of an x, of a y) of distinct (x, y) with weights, in one job."""
    pairs = F.sum("w").cast("double") * (F.sum("w").cast("double") - 1) / 2
    own = F.sum(F.col("w").cast("double") * (F.col("w").cast("double") - 1) / 2)
    union = cells.agg(pairs.alias("p"), F.lit(0).cast("long").alias("most")).select(F.lit(0).alias("i"), "p", "most")
    for i, key in ((1, "x"), (2, "y")):
        tied = cells.groupBy(key).agg(pairs.alias("p"), F.count("*").alias("n")).agg(F.sum("p").alias("p"), F.max("n").alias("most"))
        union = union.unionByName(tied.select(F.lit(i).alias("i"), "p", "most"))
    union = union.unionByName(cells.agg(own.alias("p"), F.lit(0).cast("long").alias("most")).select(F.lit(3).alias("i"), "p", "most"))
    found = {r["i"]: r for r in union.collect()}  # four rows
    return *(found[i]["p"] or 0.0 for i in range(4)), found[1]["most"] or 0, found[2]["most"] or 0


def _tau_b(all_pairs: float, n1: float, n2: float, n3: float, discordant: float) -> float | None:
    scale = ((all_pairs - n1) * (all_pairs - n2)) ** 0.5
    return (all_pairs - n1 - n2 + n3 - 2 * discordant) / scale if scale else None


def kendall(
    df: DataFrame, columns: Sequence[str], per_group: int = POINTS_PER_GROUP, per_range: int = POINTS_PER_RANGE, per_value: int = POINTS_PER_VALUE
) -> DataFrame:
    """Tau-b per pair of columns.

    Rows are reduced to distinct (x, y) with counts.  When these fit one bounded group they
    are counted there.  Otherwise, where the cells of each value of a column fit one task, they
    are counted by ranges of values.  Else they are numbered in (x, y) order and again in (y,
    first number) order: on these two permutations a pair is discordant exactly when x and y
    disagree strictly, and the pairs are counted block by block.
    """
    spark = df.sparkSession
    rows = []
    for x, y in combinations(columns, 2):
        cells = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
        cells = materialize(cells.groupBy("x", "y").agg(F.count("*").alias("w")), "cells")
        distinct = cells.count()
        corr = None
        if distinct:
            *ties, most_x, most_y = _tie_counts(cells)
            if distinct <= per_group:
                whole = cells.withColumn("one", F.lit(1))
                discordant = _count_within(whole, "one", "x", "y").first()["d"]
            elif min(most_x, most_y) <= per_value:
                few, other = ("x", "y") if most_x <= most_y else ("y", "x")
                discordant = _discordant_by_values(cells, few, other, distinct, per_range, per_group)
            else:
                by_x = number_rows(cells, ["x", "y"])
                both = number_rows(by_x.frame.withColumnRenamed(ORDINAL, "a"), ["y", "a"])
                discordant = discordant_pairs(both.frame.select("a", F.col(ORDINAL).alias("b"), "w"), both.total, per_group)
            corr = _tau_b(*ties, discordant)
        rows.append(("kendall", x, y, corr))
    return spark.createDataFrame(rows, _PAIR_SCHEMA)


def correlations(
    df: DataFrame, columns: Sequence[str] | None = None, methods: Sequence[str] = METHODS
) -> DataFrame:
    """Unordered pairs for each known method; empty below two numeric columns."""
    names = numeric_columns(df, columns)
    out = df.sparkSession.createDataFrame([], _PAIR_SCHEMA)
    if len(names) < 2:
        return out
    data = select_numeric(df, names)
    kernels = {"pearson": pearson, "spearman": spearman, "kendall": kendall}
    for method in methods:
        if method in kernels:
            out = out.unionByName(kernels[method](data, names))
    return out


def matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full matrix: both orders of each pair plus the diagonal."""
    mirrored = pairs.select("method", F.col("col2").alias("col1"), F.col("col1").alias("col2"), "corr")
    names = F.array(*[F.lit(c) for c in columns])
    diagonal = pairs.select("method").distinct().select("method", F.explode(names).alias("col1"))
    diagonal = diagonal.select("method", "col1", F.col("col1").alias("col2"), F.lit(1.0).alias("corr"))
    return pairs.unionByName(mirrored).unionByName(diagonal)


def strong_pairs(pairs: DataFrame, threshold: float = STRONG) -> DataFrame:
    """Pairs whose absolute correlation exceeds the threshold."""
    return pairs.filter(F.abs("corr") > threshold)


def bucket(pairs: DataFrame) -> DataFrame:
    """Heat-map symbol of each correlation."""
    r = F.col("corr")
    symbol = (
        F.when(r > 0.7, "++").when(r > 0.3, "+").when(r < -0.7, "--").when(r < -0.3, "-").otherwise("0")
    )
    return pairs.withColumn("bucket", symbol)
