"""Exact quantiles (linear interpolation) without holding a whole column in one task.

``F.percentile`` is exact but keeps every distinct value of a group in the final task, so
it is used only where the row count shows that this is small.  Larger columns are narrowed
by sketch brackets and exact counts; larger groups go through the cumulated histogram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsight.functions.columns import number
from tabsight.operators.ordered import ORDINAL, cumulate
from tabsight.sources.scratch import materialize

DIRECT_ROWS = 4_000_000  # values one final aggregate may hold, over all its columns
GROUP_ROWS = 1_000_000  # rows of one group a task may hold
SKETCH_ACCURACY = 10_000


def interpolation_ranks(n: int, q: float) -> tuple[int, int, float]:
    position = q * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def _direct(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    row = df.agg(*[F.percentile(c, F.lit(list(map(float, probs)))).alias(f"p{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[f"p{i}"]) if row[f"p{i}"] is not None else [None] * len(probs) for i, c in enumerate(columns)}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], direct_rows: int = DIRECT_ROWS
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns: ``{column: [value per prob]}`` (one number per column and prob)."""
    columns = list(columns)
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(columns)}
    share = direct_rows // max(1, len(columns))  # all direct columns meet in one final task
    small = [c for c in columns if sizes[c] <= share]
    large = [c for c in columns if sizes[c] > share]
    found = _direct(df, small, probs) if small else {}
    if large:
        targets = {
            (c, i): interpolation_ranks(sizes[c], q) for c in large for i, q in enumerate(probs)
        }
        ranks = sorted({(c, r) for (c, _), (lo, hi, _) in targets.items() for r in (lo, hi)})
        values = select_ranks(df, ranks, sizes, max(1, direct_rows // len(ranks)))
        for c in large:
            found[c] = []
            for i in range(len(probs)):
                lo, hi, frac = targets[c, i]
                a, b = values[c, lo], values[c, hi]
                found[c].append(a + (b - a) * frac)
    return {c: found[c] for c in columns}


def select_ranks(
    df: DataFrame, ranks: Sequence[tuple[str, int]], sizes: dict[str, int], direct_rows: int
) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank.  Each round is two scans with bounded aggregate state.

    A round sketches the rows still inside a rank's bracket, tightens the bracket around the
    wanted rank, and counts exactly how many values lie below and inside it.
    """
    state = {key: {"lo": None, "hi": None, "below": 0, "inside": sizes[key[0]]} for key in ranks}
    values: dict[tuple[str, int], float] = {}

    def inside(key: tuple[str, int]) -> Column:
        s, x = state[key], F.col(key[0])
        if s["lo"] is None:
            return x.isNotNull()
        return (x >= s["lo"]) & (x <= s["hi"])

    while state:
        pending = list(state)
        ready = [k for k in pending if state[k]["inside"] <= direct_rows]
        if ready:
            aggs = []
            for j, k in enumerate(ready):
                s = state[k]
                q = (k[1] - s["below"]) / max(1, s["inside"] - 1)
                aggs.append(F.percentile(F.when(inside(k), F.col(k[0])), F.lit(q)).alias(f"v{j}"))
            row = df.agg(*aggs).first()
            for j, k in enumerate(ready):
                values[k] = float(row[f"v{j}"])
                del state[k]
            continue
        brackets: dict[tuple, list[tuple[str, int]]] = {}  # ranks that share a bracket share one sketch
        for k in pending:
            brackets.setdefault((k[0], state[k]["lo"], state[k]["hi"]), []).append(k)
        aggs = []
        margin = 2.0 / SKETCH_ACCURACY
        for j, keys in enumerate(brackets.values()):
            shares = [(k[1] - state[k]["below"]) / max(1, state[k]["inside"] - 1) for k in keys]
            span = F.lit([edge for s in shares for edge in (max(0.0, s - margin), min(1.0, s + margin))])
            values_in = F.when(inside(keys[0]), F.col(keys[0][0]))
            aggs.append(F.percentile_approx(values_in, span, F.lit(SKETCH_ACCURACY)).alias(f"b{j}"))
        bounds = df.agg(*aggs).first()
        tight = {}
        for j, keys in enumerate(brackets.values()):
            for i, k in enumerate(keys):
                tight[k] = tuple(bounds[f"b{j}"][2 * i : 2 * i + 2])
        aggs = []
        for j, (k, (lo, hi)) in enumerate(tight.items()):
            x = F.col(k[0])
            aggs += [
                F.count_if(x < lo).alias(f"l{j}"),
                F.count_if((x >= lo) & (x <= hi)).alias(f"i{j}"),
            ]
        row = df.agg(*aggs).first()
        for j, (k, (lo, hi)) in enumerate(tight.items()):
            below, within, previous = row[f"l{j}"], row[f"i{j}"], state[k]
            missed = not below <= k[1] < below + within
            if lo == hi and not missed:
                values[k] = float(lo)
                del state[k]
            elif missed or within >= previous["inside"]:
                # the sketch does not help any further: rank the bracket's value histogram
                values[k] = _by_histogram(df.filter(inside(k)), k, previous["below"])
                del state[k]
            else:
                state[k] = {"lo": lo, "hi": hi, "below": below, "inside": within}
    return values


def _by_histogram(df: DataFrame, key: tuple[str, int], below: int) -> float:
    column, rank = key
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = cumulate(counts, ["value"], "n").frame
    wanted = rank - below
    hit = placed.filter((F.col(ORDINAL) <= wanted) & (F.col(ORDINAL) + F.col("n") > wanted)).first()
    return float(hit["value"])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group (all rows without keys)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    direct_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per group and column: array ``q`` of quantiles, as (keys…, column, q).

    Groups up to ``direct_rows`` rows use the built-in aggregate (partial maps, one shuffle);
    larger groups are cut out and answered from a range-sorted value histogram.  Their keys, at
    most one per ``direct_rows`` rows of the table, are broadcast: a join by key would put each
    group whole into one task, and the histogram would be counted there.
    """
    keys, columns = list(keys), list(columns)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    hot = materialize(sizes.filter(F.col("_size") > direct_rows).select(*keys), "hot")
    if hot.isEmpty():
        return _percentile_by_group(df, keys, columns, probs)
    hot = F.broadcast(hot)
    cold_rows = df.join(hot, keys, "left_anti")
    hot_rows = df.join(hot, keys, "left_semi")
    return _percentile_by_group(cold_rows, keys, columns, probs).unionByName(
        _histogram_by_group(hot_rows, keys, columns, probs)
    )


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """(keys…, column, value) with one row per cell that is neither null nor NaN (or per cell, missing as null)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("value")) for c in columns])
    long = df.select(*keys, F.inline(cells))
    return long if keep_missing else long.filter(F.col("value").isNotNull())


def _percentile_by_group(df: DataFrame, keys: list[str], columns: list[str], probs: Sequence[float]) -> DataFrame:
    grid = F.lit(list(map(float, probs)))
    wide = df.groupBy(*keys).agg(*[F.percentile(c, grid).alias(f"_q{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns)])
    return wide.select(*keys, F.inline(cells))


_MERGING = "spark.sql.adaptive.coalescePartitions.enabled"


@contextmanager
def partitions_apart(spark: SparkSession) -> Iterator[None]:
    """While this holds, run-time merging leaves the configured number of shuffle partitions.

    For counts of values that are written: merging looks at compressed bytes, and sorted or repeated values
    compress so well that a few tasks would hold the values of all.
    """
    before = spark.conf.get(_MERGING)
    spark.conf.set(_MERGING, "false")
    try:
        yield
    finally:
        spark.conf.set(_MERGING, before)


def value_counts(cells: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope…, value, n): rows of each value, counted once and written."""
    with partitions_apart(cells.sparkSession):
        return materialize(cells.groupBy(*scope, "value").agg(F.count("*").alias("n")), "counts")


def _histogram_by_group(df: DataFrame, keys: list[str], columns: list[str], probs: Sequence[float]) -> DataFrame:
    scope = [*keys, "column"]
    return quantiles_of_counts(value_counts(melt(df, keys, columns), scope), scope, probs)


def quantiles_of_counts(counts: DataFrame, scope: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(scope…, q): quantiles of each group from counts ``n`` of its values ``value``; null keys are groups too."""
    placed = cumulate(counts, [*scope, "value"], "n").frame
    spans = placed.groupBy(*scope).agg(F.min(ORDINAL).alias("_start"), F.sum("n").alias("_n"))
    through = F.col(ORDINAL) - F.col("_start") + F.col("n")
    picks = []
    for i, q in enumerate(probs):
        low = F.floor(F.lit(float(q)) * (F.col("_n") - 1))
        picks.append(F.min(F.when(through > low, F.col("value"))).alias(f"_a{i}"))
        picks.append(F.min(F.when(through > F.least(low + 1, F.col("_n") - 1), F.col("value"))).alias(f"_b{i}"))
    # written, so that the join is planned with its real size: few groups do not move the values of each into one task
    spans = materialize(spans.select(*[F.col(c).alias(f"_of_{c}") for c in scope], "_start", "_n"), "spans")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in scope]
    found = placed.join(spans, same).groupBy(*scope).agg(F.first("_n").alias("_n"), *picks)
    values = []
    for i, q in enumerate(probs):
        position = F.lit(float(q)) * (F.col("_n") - 1)
        values.append(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (position - F.floor(position)))
    return found.select(*scope, F.array(*values).alias("q"))
