"""Clusters of rows: k means with oversampled seeding, exact and independent of partitioning.

Values are scaled to whole numbers between their column's ends, centres are whole numbers too, so distances
and sums are exact: neither the order of rows nor the number of tasks changes a result.  Points are
written once, a column for each axis, and once more in blocks of some thousand points, which a round reads
without a step for each row; a round is one pass that leaves a count and a sum per centre and task, and
its centres are written before the next round reads them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import number, numeric_columns
from tabsight.sources.scratch import materialize

GRAIN = 1 << 20  # steps between a column's least and greatest value
OVERSAMPLE = 2  # seeds drawn in a round, as a multiple of k
SEED_ROUNDS = 5
ROUNDS = 20
_BATCH = 4096
_BLOCK = 1536  # numbers in a written block


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each point's nearest centre, the first among equals."""
    axes = np.ascontiguousarray(points.T)
    place, best = np.zeros(len(points), dtype=np.int64), np.full(len(points), np.iinfo(np.int64).max)
    d, step = np.empty_like(best), np.empty_like(best)
    for i, c in enumerate(centres):
        d.fill(0)
        for axis, at in zip(axes, c):
            np.subtract(axis, at, out=step)
            np.multiply(step, step, out=step)
            np.add(d, step, out=d)
        closer = d < best
        np.copyto(place, i, where=closer)
        np.copyto(best, d, where=closer)
    return place, best


def _points_of(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).T


def _totals(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums, by place, of a batch of whole numbers that are not negative."""
    low = np.bincount(place, values & 0xFFFFFF, size).astype(np.int64)
    return (np.bincount(place, values >> 24, size).astype(np.int64) << 24) + low


@dataclass(frozen=True)
class Scaled:
    """Points as whole numbers: (ids…, a column for each axis), and the ends of each column."""

    table: DataFrame
    blocks: DataFrame  # (block): some points one after the other, as 32-bit whole numbers
    ids: tuple[str, ...]
    columns: tuple[str, ...]
    ends: tuple[tuple[float, float], ...]

    @property
    def axes(self) -> list[str]:
        return [f"_p{i}" for i in range(len(self.columns))]

    @property
    def points(self) -> DataFrame:
        """(ids…, point)."""
        return self.table.select(*self.ids, F.array(*self.axes).alias("point"))

    def unscaled(self, point: Sequence[int]) -> list[float]:
        return [low + (high - low) * p / GRAIN for p, (low, high) in zip(point, self.ends)]


def scale(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None) -> Scaled:
    """The rows with a finite value in every column, written; ``ids`` should name a row."""
    chosen = numeric_columns(df, columns) if columns else [c for c in numeric_columns(df) if c not in ids]
    cells = {c: F.when(F.abs(number(df, c)) != float("inf"), number(df, c)) for c in chosen}
    whole = df.select(*ids, *[v.alias(f"_p{i}") for i, v in enumerate(cells.values())]).dropna(subset=[f"_p{i}" for i in range(len(cells))])
    names = [f"_p{i}" for i in range(len(chosen))]
    got = whole.agg(F.count("*").alias("n"), *[f(n).alias(f"{k}{n}") for n in names for k, f in (("a", F.min), ("b", F.max))]).first()
    ends = tuple((got[f"a{n}"] or 0.0, got[f"b{n}"] or 0.0) for n in names)
    def step(n: str, low: float, high: float) -> Column:
        if high <= low:
            return F.lit(0).cast("bigint")
        place = (F.col(n) - low) / (high - low) * GRAIN
        under = place.cast("bigint")  # not negative; the built-in rounding of doubles goes through decimals
        return under + F.when(place - under >= 0.5, 1).otherwise(0)

    axes = [step(n, low, high).alias(n) for n, (low, high) in zip(names, ends)]
    table = materialize(whole.select(*ids, *axes), "points")
    return Scaled(table, _blocks(table.select(*names)), tuple(ids), tuple(chosen), ends)


def _blocks(points: DataFrame) -> DataFrame:
    """The points, written as binary rows of some hundred points: small ones, as Spark counts rows to a batch, not bytes."""
    size = max(1, _BLOCK // max(1, len(points.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _points_of(batch, range(batch.num_columns)).astype(np.int32)
                packed = [x[start : start + size].tobytes() for start in range(0, len(x), size)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["block"])

    return materialize(points.mapInArrow(run, "block binary"), "blocks")


def _round(scaled: Scaled, centres: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """(rows, sum of squared distances, sum of points) of each centre that is nearest to a point; one row per centre and task is shuffled."""
    schema = "centre int, n bigint, inertia decimal(38,0), sums array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres)
        n, inertia, sums = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=object), np.zeros(centres.shape, dtype=np.int64)
        for batch in batches:
            points = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(-1, centres.shape[1])
            for start in range(0, len(points), _BATCH):
                x = points[start : start + _BATCH].astype(np.int64)
                place, distance = nearest(x, centres)
                n += np.bincount(place, minlength=k)
                inertia += _totals(place, distance, k)
                for axis in range(centres.shape[1]):
                    sums[:, axis] += _totals(place, x[:, axis], k)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(n[some]), pa.array([Decimal(inertia[i]) for i in some], pa.decimal128(38, 0)),
                 pa.array(list(sums[some]), pa.list_(pa.int64()))],
                names=["centre", "n", "inertia", "sums"])

    partial = scaled.blocks.mapInArrow(run, schema)
    cells = partial.select("centre", "n", "inertia", F.posexplode("sums").alias("axis", "s"))
    per_axis = cells.groupBy("centre", "axis").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, int, list[int]]] = {}
    for r in sorted(per_axis.collect(), key=lambda r: (r["centre"], r["axis"])):  # centres x columns rows
        out.setdefault(r["centre"], (r["n"], int(r["inertia"]), []))[2].append(int(r["s"]))
    return out


def seeds(scaled: Scaled, k: int, seed: int = 0) -> np.ndarray:
    """At most ``k`` centres to start from.

    Rounds draw about ``OVERSAMPLE`` x k points each, by hashes of the points and with odds that grow with
    the squared distance to what was drawn before; the draws, weighted by the rows nearest to them, are then
    thinned to k one by one, each as far and heavy as possible.  Fewer distinct points give fewer centres.
    """
    draw = lambda i: F.pmod(F.xxhash64(F.array(*scaled.axes), F.lit(seed), F.lit(i)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    first = scaled.table.select(F.array(*scaled.axes).alias("point"), draw(0).alias("u")).orderBy("u", "point").first()
    if first is None:
        return np.zeros((0, len(scaled.columns)), dtype=np.int64)
    taken = np.array([first["point"]], dtype=np.int64)
    for i in range(1, SEED_ROUNDS + 1):
        spread = float(sum(v[1] for v in _round(scaled, taken).values()))
        if not spread:
            break
        wanted = OVERSAMPLE * k
        # no distance exceeds that of opposite corners: only rows below these odds are looked at one by one
        odds = wanted * (len(scaled.axes) * GRAIN**2 / spread) * (1 + 1e-9)

        def run(batches: Iterator[pa.RecordBatch], taken: np.ndarray = taken) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    distance = nearest(_points_of(batch, range(taken.shape[1])), taken)[1]
                    keep = batch.column(taken.shape[1]).to_numpy() < wanted * (distance / spread)
                    yield batch.select(range(taken.shape[1])).filter(pa.array(keep))

        # equal points share their draw, so distinct ones are what is collected: about wanted points
        near = scaled.table.select(*scaled.axes, draw(i).alias("u")).filter(F.col("u") <= odds)
        more = [list(r) for r in near.mapInArrow(run, scaled.table.select(*scaled.axes).schema).distinct().collect()]
        taken = np.unique(np.concatenate([taken, np.array(more, dtype=np.int64).reshape(-1, taken.shape[1])]), axis=0)
    counted = _round(scaled, taken)
    weights = [counted.get(i, (0,))[0] for i in range(len(taken))]
    chosen = [max(range(len(taken)), key=lambda i: (weights[i], -i))]
    while len(chosen) < min(k, len(taken)):
        distance = nearest(taken, taken[chosen])[1]
        scores = [weights[i] * int(distance[i]) for i in range(len(taken))]
        best = max(range(len(taken)), key=lambda i: (scores[i], -i))
        if not scores[best]:
            break
        chosen.append(best)
    return taken[chosen]


@dataclass(frozen=True)
class Clustering:
    """Centres in their last state and the written states of all rounds (round, centre, n, inertia, point)."""

    scaled: Scaled
    centres: np.ndarray
    sizes: list[int]
    inertia: list[int]
    rounds: int
    history: DataFrame


def cluster(scaled: Scaled, k: int, seed: int = 0, rounds: int = ROUNDS, start: np.ndarray | None = None) -> Clustering:
    """Centres that no longer move, or those after ``rounds`` rounds; a centre without rows stays where it is.

    ``start`` gives centres to start from, such as those of a written state.
    """
    spark = scaled.table.sparkSession
    centres = seeds(scaled, k, seed) if start is None else np.asarray(start, dtype=np.int64)
    history, at = None, 0
    while True:
        found = _round(scaled, centres) if len(centres) else {}
        rows = [(at, i, found.get(i, (0,))[0], found.get(i, (0, 0))[1], [int(c) for c in centres[i]]) for i in range(len(centres))]
        state = materialize(
            spark.createDataFrame([(a, b, n, str(s), p) for a, b, n, s, p in rows], "round int, centre int, n bigint, inertia string, point array<bigint>")
            .withColumn("inertia", F.col("inertia").cast("decimal(38,0)")).coalesce(1), "centres")
        history = state if history is None else history.unionByName(state)
        # half a step up from the exact mean
        moved = np.array([[(2 * s + n) // (2 * n) for s in found[i][2]] if (n := rows[i][2]) else centres[i] for i in range(len(centres))],
                         dtype=np.int64).reshape(centres.shape)
        if at >= rounds or (moved == centres).all():
            return Clustering(scaled, centres, [r[2] for r in rows], [r[3] for r in rows], at, history)
        centres, at = moved, at + 1


def assign(found: Clustering) -> DataFrame:
    """(ids…, cluster, distance2): the nearest centre of each row, and its squared distance on scaled values."""
    centres, ids = found.centres, list(found.scaled.ids)
    rows = found.scaled.table.select(*ids, *found.scaled.axes)
    width = len(found.scaled.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place, distance = nearest(_points_of(batch, range(len(ids), len(ids) + width)), centres)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(ids)], pa.array(place, pa.int32()), pa.array(distance / GRAIN**2)], names=[*ids, "cluster", "distance2"])

    schema = rows.select(*ids, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance2")).schema
    for f in schema.fields:
        f.nullable = True
    return rows.mapInArrow(run, schema)


def summarize(found: Clustering) -> DataFrame:
    """(cluster, n, share, inertia, column, centre): one row per cluster and column, centres on the columns' own scale."""
    total = sum(found.sizes)
    rows = [
        (i, found.sizes[i], found.sizes[i] / total if total else None, found.inertia[i] / GRAIN**2, c, v)
        for i, centre in enumerate(found.centres.tolist())
        for c, v in zip(found.scaled.columns, found.scaled.unscaled(centre))
    ]
    return found.scaled.table.sparkSession.createDataFrame(
        rows, "cluster int, n bigint, share double, inertia double, column string, centre double")


def separation(found: Clustering) -> float:
    """Calinski-Harabasz index: spread between the centres over spread within, each by its degrees of freedom."""
    n, k = sum(found.sizes), sum(s > 0 for s in found.sizes)
    if k < 2 or n <= k:
        return 0.0
    sizes = np.array(found.sizes, dtype=float)
    centre = (found.centres * sizes[:, None]).sum(axis=0) / n
    between = float((((found.centres - centre) ** 2).sum(axis=1) * sizes).sum())
    within = float(sum(found.inertia))
    return float("inf") if within == 0 else between / (k - 1) / (within / (n - k))


def natural_clusters(scaled: Scaled, most: int = 8, seed: int = 0) -> Clustering:
    """The clustering into 2 to ``most`` clusters that separates best."""
    return max((cluster(scaled, k, seed) for k in range(2, most + 1)), key=separation)


def cluster_finding(found: Clustering) -> str:
    """One sentence for a report."""
    # Fixed value: the wording.
    return f"Data naturally groups into {sum(s > 0 for s in found.sizes)} distinct clusters"
