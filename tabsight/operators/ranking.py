"""Scenario scoring, ranking by criterion and the Pareto front over large entity tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tabsight.operators.ordered import rank_within
from tabsight.sources.scratch import materialize

CRITERIA = ("cost_effectiveness", "risk_reduction", "timeline_efficiency", "resource_utilization")
FRONT_STEP = 10_000
_COMPARE_CELLS = 4_000_000


def whatif_projection(scenarios: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids…, parameter, predicted, low, high): 10 % change per unit of the parameter, ±20 % band.

    ``parameters`` and ``expected_outcomes`` are map<string,double>; a parameter without an
    expected outcome starts from 0.
    """
    rows = scenarios.select(*ids, "expected_outcomes", F.explode("parameters").alias("parameter", "amount"))
    base = F.coalesce(F.try_element_at("expected_outcomes", F.col("parameter")), F.lit(0.0))
    predicted = base * (1 + F.col("amount") * 0.1)
    rows = rows.withColumn("predicted", predicted)
    return rows.select(
        *ids, "parameter", "predicted", (F.col("predicted") * 0.8).alias("low"), (F.col("predicted") * 1.2).alias("high")
    )


def _map_mean(column: str, default: float):
    values = F.map_values(column)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(default))


def criterion_scores(results: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids…, four scores) from map columns of outcomes, utilization, risk and timeline."""
    outcome = _map_mean("predicted_outcomes", 0.0)
    risk = F.coalesce(F.try_element_at("risk_assessment", F.lit("overall_risk")), F.lit(0.5))
    days = F.coalesce(F.try_element_at("timeline_impact", F.lit("implementation_days")), F.lit(90.0))
    return results.select(
        *ids,
        (outcome / F.greatest(_map_mean("resource_utilization", 1.0), F.lit(0.1))).alias("cost_effectiveness"),
        (1.0 - risk).alias("risk_reduction"),
        (1.0 - days / 365.0).alias("timeline_efficiency"),
        (1.0 - F.abs(_map_mean("resource_utilization", 0.5) - 0.7)).alias("resource_utilization"),
    )


def criterion_rank(scores: DataFrame, entity: str, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """(criterion, entity, score, rank, n): best score first, ties by entity.

    Each criterion ranks every entity, so ranks come from one range sort, not from a window
    with as many tasks as criteria.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in criteria])
    long = scores.select(F.col(entity), F.inline(cells))
    placed = rank_within(long, ["criterion"], [F.col("score").desc(), F.col(entity)])
    return placed.withColumnRenamed("_n", "n")


def average_points(ranks: DataFrame, entity: str) -> DataFrame:
    """(entity, average_score): mean over criteria of n for the first place down to 1 for the last."""
    return ranks.groupBy(entity).agg(F.avg(F.col("n") - F.col("rank") + 1).alias("average_score"))


def best_overall(ranks: DataFrame, entity: str) -> DataFrame:
    """The entity with the best average place."""
    return average_points(ranks, entity).orderBy(F.desc("average_score"), entity).limit(1)


def best_per_criterion(ranks: DataFrame, entity: str) -> DataFrame:
    """(criterion, entity, score) of each first place."""
    return ranks.filter(F.col("rank") == 1).select("criterion", entity, "score")


def dominated_mask(points: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Which points some front point beats: at least as good everywhere and better somewhere."""
    out = np.zeros(len(points), dtype=bool)
    if not len(points) or not len(front):
        return out
    step = max(1, _COMPARE_CELLS // max(1, len(front)))
    for start in range(0, len(points), step):
        part = points[start : start + step]
        as_good = np.ones((len(part), len(front)), dtype=bool)
        better = np.zeros((len(part), len(front)), dtype=bool)
        for j in range(points.shape[1]):
            ours, theirs = part[:, j, None], front[None, :, j]
            as_good &= theirs >= ours
            better |= theirs > ours
        out[start : start + step] = (as_good & better).any(axis=1)
    return out


def local_front(points: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Indices of points no other point dominates.  A dominating point sorts first by
    (sum, values), so each chunk is checked against the front so far and within itself."""
    order = np.lexsort(tuple(-points[:, j] for j in reversed(range(points.shape[1]))) + (-points.sum(axis=1),))
    kept = np.empty(0, dtype=np.int64)
    for start in range(0, len(order), chunk):
        ids = order[start : start + chunk]
        ids = ids[~dominated_mask(points[ids], points[kept])]
        ids = ids[~dominated_mask(points[ids], points[ids])]
        kept = np.concatenate([kept, ids])
    return kept


def _block_fronts(names: list[str]):
    """What no row of the same partition dominates; the partition holds one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for pdf in batches:
            both = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            kept = both.iloc[np.sort(local_front(both[names].to_numpy()))]
        if kept is not None:
            yield kept

    return run


def _challenged(names: list[str]):
    """Rows of each block (role 0) that no challenger (role 1, sorted behind them) dominates; one block is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alive: pd.DataFrame | None = None
        for pdf in batches:
            for block, part in pdf.groupby("_block", sort=True):
                if alive is not None and alive["_block"].iat[0] != block:
                    yield alive
                    alive = None
                own, others = part[part["_role"] == 0], part[part["_role"] == 1]
                if len(own):
                    alive = own if alive is None else pd.concat([alive, own], ignore_index=True)
                if len(others) and alive is not None:
                    beaten = dominated_mask(alive[names].to_numpy(), others[names].to_numpy())
                    alive = None if beaten.all() else alive[~beaten]
        if alive is not None:
            yield alive

    return run


def pareto_front(scores: DataFrame, entity: str, criteria: Sequence[str] = CRITERIA, step: int = FRONT_STEP) -> DataFrame:
    """Entities no other entity dominates; equal entities stay together.

    An entity with a null or NaN criterion is not comparable: it is not on the front and beats
    nothing.

    Batches first drop what they dominate themselves.  What is left is cut into ranges of about
    ``step`` rows in (sum, values) order, and each range is reduced to its own front in its task.
    Whatever dominates a row sorts before it, so a range is then compared with the fronts of the
    better ranges alone, and of these with the rows that reach its least value in every criterion.
    A task holds one range; the rows that challenge it pass by in batches.  Only the number
    of rows reaches the driver.
    """
    names = list(criteria)
    kind = scores.schema[entity].dataType
    ids = F.col(entity)
    if isinstance(kind, T.IntegralType):  # beside a null pandas would hold whole numbers as doubles
        ids = F.coalesce(ids, F.lit(0).cast(kind))
    data = scores.select(ids.alias(entity), F.col(entity).isNull().alias("_none"), *[F.col(c).cast("double").alias(c) for c in names])
    for c in names:
        data = data.filter(F.col(c).isNotNull() & ~F.isnan(c))
    schema = data.schema
    result = [F.when(~F.col("_none"), F.col(entity)).alias(entity), *names]

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.iloc[np.sort(local_front(pdf[names].to_numpy()))] if len(pdf) else pdf

    total = None
    for c in names:
        total = F.col(c) if total is None else total + F.col(c)
    order = [F.desc("_sum"), *[F.desc(c) for c in names], F.col(entity)]
    left = materialize(data.mapInPandas(shrink, schema).withColumn("_sum", total), "front")
    blocks = -(-left.count() // step)
    if blocks <= 1:
        return left.drop("_sum").repartition(1).mapInPandas(_block_fronts(names), schema).select(*result)
    ranged = left.repartitionByRange(blocks, *order).drop("_sum").withColumn("_block", F.spark_partition_id())
    fronts = materialize(ranged.mapInPandas(_block_fronts(names), ranged.schema), "front")
    least = fronts.groupBy("_block").agg(*[F.min(c).alias(f"_least{i}") for i, c in enumerate(names)])
    later = fronts.filter(F.col("_block") < blocks - 1).withColumn(
        "_block", F.explode(F.sequence(F.col("_block") + 1, F.lit(blocks - 1)))
    )
    reach = None
    for i, c in enumerate(names):
        as_good = F.col(c) >= F.col(f"_least{i}")
        reach = as_good if reach is None else reach & as_good
    challengers = later.join(least, "_block").filter(reach).select(*fronts.columns, F.lit(1).alias("_role"))
    met = fronts.withColumn("_role", F.lit(0)).unionByName(challengers)
    met = met.repartition(blocks, "_block").sortWithinPartitions("_block", "_role")
    return materialize(met.mapInPandas(_challenged(names), met.schema).select(*result), "front")


def dominance_split(scores: DataFrame, entity: str, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """(entity, pareto_efficient) for every entity."""
    front = pareto_front(scores, entity, criteria).select(entity, F.lit(True).alias("efficient"))
    marked = scores.select(entity).join(front, entity, "left")
    return marked.select(entity, F.coalesce("efficient", F.lit(False)).alias("pareto_efficient"))
