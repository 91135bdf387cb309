"""Outlier detection by six methods, method comparison and consensus.

Bounds are a handful of scalars, so the four threshold methods become predicates of one
projection over the table.  The isolation forest in one dimension is a step function, and
the local outlier factor works on overlapping blocks of the sorted column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsight.functions.columns import number, numeric_columns
from tabsight.operators.ordered import BLOCK, ORDINAL, blocks, number_rows, spread
from tabsight.operators.quantiles import exact_quantiles
from tabsight.sources.scratch import materialize

DEFAULT_METHODS = ("iqr", "zscore", "isolation_forest")
THRESHOLD_METHODS = ("iqr", "zscore", "modified_zscore", "percentile")
THRESHOLDS = {
    "zscore": 3.0, "iqr": 1.5, "isolation_forest": 0.1, "modified_zscore": 3.5, "lof": 0.1, "percentile": 0.05,
}
FOREST_MIN_ROWS = 10
LOF_MIN_ROWS = 20
TREES = 100
TREE_ROWS = 256
SEED = 42


def _bounds(df: DataFrame, columns: Sequence[str], methods: Sequence[str], thresholds: Mapping[str, float]) -> dict:
    """Per column and method the outlier predicate, or None where the method flags nothing."""
    predicates: dict[tuple[str, str], Column | None] = {}
    probs = []
    if "iqr" in methods:
        probs += [0.25, 0.75]
    if "modified_zscore" in methods:
        probs += [0.5]
    if "percentile" in methods:
        probs += [thresholds["percentile"], 1 - thresholds["percentile"]]
    q = {}
    if probs:
        found = exact_quantiles(df, columns, probs)
        q = {c: dict(zip(probs, found[c])) for c in columns}
    mads = {}
    if "modified_zscore" in methods:
        live = [c for c in columns if q[c][0.5] is not None]
        shifted = df.select(*[F.abs(F.col(c) - F.lit(q[c][0.5])).alias(c) for c in live])
        mads = {c: v[0] for c, v in exact_quantiles(shifted, live, [0.5]).items()}
    spread = {}
    if "zscore" in methods:
        row = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
        spread = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    for c in columns:
        x = F.col(c)
        for method in methods:
            t = thresholds[method]
            if method == "iqr" and q[c][0.25] is not None:
                low, high = q[c][0.25], q[c][0.75]
                reach = t * (high - low)
                test = (x < F.lit(low - reach)) | (x > F.lit(high + reach))
            elif method == "percentile" and q[c][t] is not None:
                test = (x < F.lit(q[c][t])) | (x > F.lit(q[c][1 - t]))
            elif method == "modified_zscore" and mads.get(c):
                test = F.abs(F.lit(0.6745) * (x - F.lit(q[c][0.5])) / F.lit(mads[c])) > t
            elif method == "zscore" and spread[c][1]:
                mean, std = spread[c]
                test = F.abs((x - F.lit(mean)) / F.lit(std)) > t
            else:
                test = None
            predicates[c, method] = test
    return predicates


def threshold_flags(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    methods: Sequence[str] = THRESHOLD_METHODS,
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """(method, column, ids…, value) of flagged rows: one scan for all columns and methods."""
    limits = {**THRESHOLDS, **(thresholds or {})}
    data = df.select(*ids, *[number(df, c).alias(c) for c in columns if c not in ids])
    predicates = {k: p for k, p in _bounds(data, columns, methods, limits).items() if p is not None}
    if not predicates:
        return _no_flags(df, ids)
    cells = [
        F.when(p, F.struct(F.lit(m).alias("method"), F.lit(c).alias("column"), F.col(c).cast("double").alias("value")))
        for (c, m), p in predicates.items()
    ]
    anywhere = None
    for p in predicates.values():
        anywhere = p if anywhere is None else anywhere | p
    return data.filter(anywhere).select(*ids, F.inline(F.array_compact(F.array(*cells))))


def _no_flags(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.select(*ids).limit(0).select(
        *ids, F.lit("").alias("method"), F.lit("").alias("column"), F.lit(0.0).alias("value")
    )


def harmonic_path(n: np.ndarray | int) -> np.ndarray:
    """Average path length of an unsuccessful search in a binary tree of n leaves (Liu et al. 2008)."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    full = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def isolation_steps(sample: np.ndarray, rng: np.random.Generator, depth_limit: int) -> tuple[list[float], list[float]]:
    """One isolation tree over a 1-D sample as (cut points, path length left of each cut and after the last)."""
    cuts: list[float] = []
    lengths: list[float] = []

    def grow(part: np.ndarray, depth: int) -> None:
        if depth >= depth_limit or len(part) <= 1 or part[0] == part[-1]:
            lengths.append(depth + float(harmonic_path(len(part))))
            return
        split = rng.uniform(part[0], part[-1])
        at = int(np.searchsorted(part, split, side="right"))
        if at in (0, len(part)):
            lengths.append(depth + float(harmonic_path(len(part))))
            return
        grow(part[:at], depth + 1)
        cuts.append(float(split))
        grow(part[at:], depth + 1)

    grow(np.sort(sample), 0)
    return cuts, lengths


def _tree_samples(df: DataFrame, ids: Sequence[str], column: str, n: int, trees: int) -> DataFrame:
    """(tree, value): for each tree the ``TREE_ROWS`` rows with the smallest (id, tree) hash.

    Every row draws for every tree inside the scan; only draws that can be among the smallest
    leave it: about four times the rows a tree needs are expected to pass, of which a tree
    keeps the smallest.
    """
    slots = 1 << 40
    data = df.select(*ids, number(df, column).alias("value")).filter(F.col("value").isNotNull())
    share = 4 * TREE_ROWS / max(1, n)
    limit = int(slots * share) if share < 1 else slots
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64(*ids, t, F.lit(SEED)), F.lit(slots)).alias("draw")),
    )
    drawn = data.select(*ids, "value", F.inline(F.filter(draws, lambda d: d["draw"] < limit)))
    order = W.partitionBy("tree").orderBy("draw", *ids)
    return drawn.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= TREE_ROWS).select("tree", "value")


def forest_scores(df: DataFrame, ids: Sequence[str], column: str, trees: int = TREES) -> DataFrame | None:
    """(ids…, value, score): anomaly score 2^(-mean path / c(ψ)); None at or below the row gate."""
    n = df.agg(F.count(number(df, column))).first()[0]
    if n <= FOREST_MIN_ROWS:
        return None
    depth_limit = math.ceil(math.log2(max(2, min(TREE_ROWS, n))))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng((SEED, int(key[0])))
        cuts, lengths = isolation_steps(pdf["value"].to_numpy(), rng, depth_limit)
        return pd.DataFrame({"cuts": [cuts], "lengths": [lengths]})

    grown = spread(_tree_samples(df, ids, column, n, trees), "tree").groupBy("tree").applyInPandas(
        build, "cuts array<double>, lengths array<double>"
    )
    # at most `trees` rows of TREE_ROWS cuts: the mean path over all trees is one step function
    forest = grown.collect()
    edges = np.unique(np.concatenate([np.asarray(t["cuts"], dtype=float) for t in forest]))
    steps = np.zeros(len(edges) + 1)
    probes = np.concatenate([edges, [np.inf]])  # interval i is (edges[i-1], edges[i]]
    for t in forest:
        steps += np.asarray(t["lengths"])[np.searchsorted(np.asarray(t["cuts"]), probes, side="left")]
    scores = np.power(2.0, -(steps / len(forest)) / float(harmonic_path(min(TREE_ROWS, n))))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(scores[np.searchsorted(edges, values.to_numpy(), side="left")])

    data = df.select(*ids, number(df, column).alias("value")).filter(F.col("value").isNotNull())
    return data.withColumn("score", score("value"))


def lof_neighbours(n: int) -> int:
    return max(2, min(20, int(math.sqrt(n))))


def lof_kernel(values: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factor (Breunig et al. 2000) of sorted 1-D values; neighbours by (distance, position)."""
    n = len(values)
    offsets = np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])
    at = np.arange(n)[:, None] + offsets[None, :]
    outside = (at < 0) | (at >= n)
    near = np.clip(at, 0, n - 1)
    distance = np.where(outside, np.inf, np.abs(values[near] - values[:, None]))
    chosen = np.argsort(distance, axis=1, kind="stable")[:, :k]
    rows = np.arange(n)[:, None]
    neighbours, gap = near[rows, chosen], distance[rows, chosen]
    reach = gap[:, -1]
    density = 1.0 / (np.maximum(reach[neighbours], gap).mean(axis=1) + 1e-10)
    return density[neighbours].mean(axis=1) / density


def lof_scores(df: DataFrame, ids: Sequence[str], column: str, block_size: int | None = None) -> DataFrame | None:
    """(ids…, value, score) with score the local outlier factor; None at or below the row gate."""
    data = df.select(*ids, number(df, column).alias("value")).filter(F.col("value").isNotNull())
    rows = number_rows(data, ["value", *ids])
    if rows.total <= LOF_MIN_ROWS:
        return None
    k = lof_neighbours(rows.total)
    size = block_size or min(200_000, max(10_000, rows.total // 64))
    # a factor depends on neighbours of neighbours of neighbours: 3k rows on either side
    placed = blocks(rows, before=3 * k, after=3 * k, size=max(size, 6 * k))
    schema = placed.drop(BLOCK, "_halo", ORDINAL)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    names = schema.columns

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDINAL)
        pdf["score"] = lof_kernel(pdf["value"].to_numpy(), k) if len(pdf) > k else np.nan
        return pdf.loc[~pdf["_halo"], [*names, "score"]]

    return spread(placed, BLOCK).groupBy(BLOCK).applyInPandas(kernel, f"{fields}, score double")


def _step_quantile(scored: DataFrame, q: float) -> float:
    """Quantile of forest scores, which take at most one value per step of the forest."""
    steps = scored.groupBy("score").agg(F.count("*").alias("n")).orderBy("score").toPandas()
    through = steps["n"].cumsum().to_numpy()
    position = q * (through[-1] - 1)
    low, high = (steps["score"].to_numpy()[np.searchsorted(through, r, side="right")] for r in (math.floor(position), math.ceil(position)))
    return float(low + (high - low) * (position - math.floor(position)))


def share_flags(scored: DataFrame, ids: Sequence[str], method: str, column: str, contamination: float) -> DataFrame:
    """Rows whose score lies strictly above the (1 - contamination) quantile of scores."""
    if method == "isolation_forest":
        cut = _step_quantile(scored, 1 - contamination)
    else:
        scored = materialize(scored, method)  # the quantile and the result both read the scores
        cut = exact_quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.filter(F.col("score") > F.lit(cut)).select(
        *ids, F.lit(method).alias("method"), F.lit(column).alias("column"), "value"
    )


def detect(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str] | None = None,
    methods: Sequence[str] = DEFAULT_METHODS,
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """(ids…, method, column, value) of every flagged row for all requested methods."""
    limits = {**THRESHOLDS, **(thresholds or {})}
    names = [c for c in numeric_columns(df, columns) if c not in ids] if columns is None else numeric_columns(df, columns)
    out = threshold_flags(df, ids, names, [m for m in methods if m in THRESHOLD_METHODS], limits)
    for method, scorer in (("isolation_forest", forest_scores), ("lof", lof_scores)):
        if method not in methods:
            continue
        for c in names:
            scored = scorer(df, ids, c)
            if scored is not None:
                out = out.unionByName(share_flags(scored, ids, method, c, limits[method]))
    return out


def method_grid(df: DataFrame, columns: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """(method, column, n) of every method that runs on a column, so zero counts stay visible."""
    row = df.agg(*[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    gate = {"isolation_forest": FOREST_MIN_ROWS, "lof": LOF_MIN_ROWS}
    cells = [
        (m, c, row[f"n{i}"]) for i, c in enumerate(columns) for m in methods if row[f"n{i}"] > gate.get(m, 0)
    ]
    return df.sparkSession.createDataFrame(cells, "method string, column string, n bigint")


def summarize(flags: DataFrame, grid: DataFrame) -> DataFrame:
    """(method, column, count, percent of non-null values)."""
    counts = flags.groupBy("method", "column").agg(F.count("*").alias("count"))
    joined = grid.join(counts, ["method", "column"], "left")
    count = F.coalesce("count", F.lit(0).cast("bigint"))
    return joined.select("method", "column", "n", count.alias("count"), (count / F.col("n") * 100).alias("percent"))


def compare_methods(summary: DataFrame) -> DataFrame:
    """Per method: outliers in all columns, columns processed, mean percent."""
    return summary.groupBy("method").agg(
        F.sum("count").alias("total_outliers"),
        F.count("*").alias("columns_processed"),
        F.avg("percent").alias("avg_percentage"),
    )


def consensus(flags: DataFrame, ids: Sequence[str], minimum: int = 2) -> DataFrame:
    """(column, ids…, agreement): rows that at least ``minimum`` methods flag in one column."""
    methods = F.size(F.collect_set("method"))  # at most six names
    agreed = flags.groupBy("column", *ids).agg(methods.cast("bigint").alias("agreement"))
    return agreed.filter(F.col("agreement") >= minimum)


def top_columns(flags: DataFrame, limit: int = 10) -> DataFrame:
    """Columns with the most flags."""
    return flags.groupBy("column").agg(F.count("*").alias("flags")).orderBy(F.desc("flags"), "column").limit(limit)
