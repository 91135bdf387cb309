import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tabsight.llm import feast, whitening

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def brute(rows, k=4):
    """Expected rows from the contract, in plain numpy."""
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {tuple(math.floor(256 * c) for c in v) for _, v in keep}
    fit = np.array(sorted(x), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, row in keep:
        own = np.array([math.floor(256 * c) for c in row], dtype=np.int64)
        w = (own - s / n) @ vectors / np.sqrt(values)
        out += [(i, j + 1, n, int(((n * own - s) ** 2).sum()), w[j], values[j] / np.trace(v)) for j in range(len(w))]
    return out


def check(got, want):
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    signs = {}
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a[5] - b[5]) < 1e-9 * b[5] and a[6] < 1e-9
        if abs(b[4]) > 1e-6:
            assert signs.setdefault(a[1], a[4] * b[4] > 0) == (a[4] * b[4] > 0)
        assert abs(abs(a[4]) - abs(b[4])) < 1e-8


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_equals_brute_force_on_whole_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table.collect()]
    check(whitening.whitened_embeddings(table).collect(), brute(rows))


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(50)]
    rows = good + [(1, good[0][1]), (1, good[0][1]), (None, good[3][1]), ((1 << 60) + 1, good[4][1]), ((1 << 60) + 3, [-0.0] * 6)]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (93, [math.nan] * 6), (94, [math.inf] + [0.0] * 5), (95, [1.0, 2.0])]
    table = spark.createDataFrame(rows + bad, VECTORS).coalesce(1).withColumn("n", F.lit("x")).withColumn("Component", F.lit(0))
    check(whitening.whitened_embeddings(table).collect(), brute(rows))
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 1.0]), (3, [1.0, 2.0])], VECTORS)
    got = whitening.whitened_embeddings(few).collect()
    assert [(r.component, r.n) for r in got] == [(1, 2)] * 3 and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)
    for none in ([], [(1, None)], [(1, [1.0]), (2, [1.0])]):
        assert whitening.whitened_embeddings(spark.createDataFrame(none, VECTORS)).count() == 0


def test_wide_deviations_are_exact_or_null():
    w = whitening.Whitener(3, np.array([3, -6]), np.ones(1), np.ones((2, 1)), 1.0)
    big = 1 << 30
    assert w.deviations(np.array([[1, 2], [big, 0]])) == [(3 - 3) ** 2 + (6 + 6) ** 2, None if (3 * big - 3) ** 2 + 36 >= 1 << 63 else (3 * big - 3) ** 2 + 36]
    assert w.deviations(np.array([[1 << 40, 0]])) == [None]


def test_eigenpairs_of_hard_spectra():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        a = q @ np.diag(rng.choice([0, 1, 2, 1e-3, 1e-7, 5, 100.0], n)) @ q.T
        values, vectors = feast.eigenpairs(a, 4)
        want = np.linalg.eigvalsh(a)[::-1][:4]
        assert np.abs(values - want).max() <= 1e-12 * max(want.max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * max(want.max(), 1e-300)


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 20, 64):
        a = rng.normal(size=(n, n))
        a += a.T
        values, inertia = np.linalg.eigvalsh(a), feast.Inertia(a)
        assert all(inertia.above(s) == (values > s).sum() for s in np.linspace(values[0] - 1, values[-1] + 1, 40))
