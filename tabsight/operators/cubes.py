"""Statistics of several grouping levels from one scan: grouping sets, rollup and cube with exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tabsight.operators.quantiles import melt, partitions_apart, quantiles_of_counts, value_counts
from tabsight.operators.stats import AGGREGATION_QUANTILES
from tabsight.sources.scratch import materialize


def rollup_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """The keys, then one key less from the right, down to none."""
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """Every subset of the keys."""
    return [s for n in range(len(keys), -1, -1) for s in combinations(keys, n)]


def level_id(keys: Sequence[str], kept: Sequence[str]) -> int:
    """The grouping id: one bit per key, the first key highest, set where the level leaves the key out."""
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in kept)


def grouping_stats(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    sets: Sequence[Sequence[str]] | None = None,
    probs: Sequence[float] = AGGREGATION_QUANTILES,
) -> DataFrame:
    """(grouping_id, keys…, column, count, sum, mean, min, max, q) for every level of ``sets`` (all subsets unless given).

    The table is read once, into counts of equal (keys, column, value).  Coarser levels add up these
    counts and quantiles come from their cumulated order, so no level reads rows again and no group is
    held in one task.  ``q`` is the array of quantiles in the order of ``probs``.  A null key is a group of
    its own, told from a left-out key by ``grouping_id``; null and NaN values are missing, a group without
    values has no row, and neither has an empty table.
    """
    keys = list(keys)
    taken = sorted({"grouping_id", "column", "value", "n"} & set(keys))
    if taken:
        raise ValueError(f"keys carry names of the result: {taken}")
    levels = cube_sets(keys) if sets is None else [tuple(s) for s in sets]
    unknown = sorted({k for s in levels for k in s} - set(keys))
    if unknown:
        raise ValueError(f"levels name other keys: {unknown}")
    levels = list(dict.fromkeys(tuple(k for k in keys if k in s) for s in levels))
    types = {k: df.schema[k].dataType for k in keys}
    cells = value_counts(melt(df, keys, columns), [*keys, "column"])
    places = [
        F.struct(
            F.lit(level_id(keys, kept)).alias("grouping_id"),
            *[(F.col(k) if k in kept else F.lit(None).cast(types[k])).alias(k) for k in keys],
        )
        for kept in levels
    ]
    scope = ["grouping_id", *keys, "column"]
    spread = cells.select("column", "value", "n", F.inline(F.array(*places)))
    with partitions_apart(df.sparkSession):
        counts = materialize(spread.groupBy(*scope, "value").agg(F.sum("n").alias("n")), "levels")
    scalars = counts.groupBy(*scope).agg(
        F.sum("n").alias("count"), F.sum(F.col("value") * F.col("n")).alias("sum"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quantiles = quantiles_of_counts(counts, scope, probs)
    same = [scalars[c].eqNullSafe(quantiles[c]) for c in scope]
    joined = scalars.join(quantiles, same)
    return joined.select(*[scalars[c] for c in scope], "count", "sum", (F.col("sum") / F.col("count")).alias("mean"), "min", "max", "q")
