"""Whitening of embeddings along their leading components.

Vectors are fixed-point numbers, floor(256 c), so sums are exact and equal vectors are found by
value.  Spark reduces the distinct vectors to counts, sums and a covariance matrix of
dimension x dimension; the components of that matrix come from contour integration (``feast``); Spark
projects every row.  Only matrices whose size is set by the dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsight.llm import feast
from tabsight.llm.common import materialize

COMPONENTS = 4
GRAIN = 256
_WIDE = 2.0**62


@dataclass(frozen=True)
class Whitener:
    """What turns a vector x into its whitened coordinates, and how exact the coordinates are."""

    n: int
    sums: np.ndarray  # per dimension over the fit list, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float = float("nan")

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 per row; None where it needs more than 64 bits."""
        rough = ((self.n * x.astype(np.float64) - self.sums) ** 2).sum(axis=1)
        if not len(rough) or rough.max() < _WIDE:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums.tolist())) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fixed_point(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part.

    Left out are vectors that are null, empty, hold null or non-finite entries, or have another length
    than most (of equally frequent lengths the smallest counts).
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("v") == (usual["size"] if usual else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * GRAIN)).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    rows = batch.column(column)
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def _summed(fit: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, list]:
    """Row sums of matrices that ``of_batch`` makes of the vectors: added up per task, then by Spark per row.

    A task gives as many rows as its matrix has, whatever the size of its input.
    """
    schema = f"row int, cells array<{kind}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(_matrix(batch, 0))
                total = part if total is None else total + part
        if total is not None:
            cells = pa.array(list(total), pa.list_(pa.int64() if kind == "long" else pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), cells], names=["row", "cells"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "cells": [np.sum(np.stack(list(pdf["cells"])), axis=0)]})

    merged = fit.mapInArrow(run, schema).groupBy("row").applyInPandas(merge, schema)
    return {r["row"]: r["cells"] for r in merged.collect()}  # one row per row of the matrix


def fit_whitener(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fitted on each distinct vector once; None without a vector that differs from another.

    Eigenvalues that are 0 to working precision have no component.
    """
    fit = materialize(rows.select("x").distinct(), "fit_list")
    first = _summed(fit, lambda x: np.stack([x.sum(axis=0), np.full(x.shape[1], len(x))]), "long")
    if not first:
        return None
    sums, n = np.array(first[0], dtype=np.int64), int(first[1][0])
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    found = _summed(fit, products, "double")
    covariance = np.array([found[i] for i in range(len(sums))]) / n
    values, vectors = feast.eigenpairs(covariance, components)
    real = values > len(sums) * np.finfo(float).eps * max(float(values.max(initial=0.0)), 1e-300)
    if not real.any():
        return None
    made = Whitener(n, sums, values[real], vectors[:, real], float(np.trace(covariance)))

    def moments(x: np.ndarray) -> np.ndarray:
        w = made.apply(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    checked = _summed(fit, moments, "double")
    k = len(made.values)
    centre = np.array(checked[k]) / n
    measured = np.array([checked[i] for i in range(k)]) / n - np.outer(centre, centre)
    return Whitener(n, sums, made.values, made.vectors, made.trace, float(np.abs(measured - np.eye(k)).max()))


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, fitted: Whitener | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row of ``fixed_point`` and component.

    Repeated rows come out each, a null id stays null, a table without a component gives no rows.
    """
    if fitted is None:
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    k = len(fitted.values)
    explained = fitted.values / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, count = _matrix(batch, 1), batch.num_rows
            each = pa.array(np.repeat(np.arange(count), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, fitted.n)),
                    pa.array(fitted.deviations(x), pa.int64()).take(each),
                    pa.array(fitted.apply(x).ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * k, fitted.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, _SCHEMA)


def whitened_embeddings(embeddings: DataFrame) -> DataFrame:
    """The leading components of all embeddings; see ``fixed_point`` for the rows that take part."""
    rows = fixed_point(embeddings)
    return whiten(rows, fit_whitener(rows))
