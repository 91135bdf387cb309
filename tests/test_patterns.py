import math
import random
from collections import Counter

import numpy as np
import pytest

from tabsight.operators import clusters, importance


def brute_lloyd(points, start):
    """Exact rounds on whole numbers in plain Python."""
    centres = [tuple(c) for c in start]
    for _ in range(200):
        near = [min(range(len(centres)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(p, centres[i])), i)) for p in points]
        moved = []
        for i, c in enumerate(centres):
            own = [p for p, n in zip(points, near) if n == i]
            moved.append(tuple((2 * sum(axis) + len(own)) // (2 * len(own)) for axis in zip(*own)) if own else c)
        if moved == centres:
            return centres, near
        centres = moved
    raise AssertionError("no end")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(5)
    middles = [(0, 0), (10, 1), (3, 9)]
    rows = [(i, *(m + rng.gauss(0, 1) for m in middles[i % 3])) for i in range(600)] + [(1000 + i, 5.0, 5.0) for i in range(300)]
    return spark.createDataFrame(rows, "id long, x double, y double")


@pytest.mark.parametrize("k", [1, 3, 5])
def test_clusters_equal_brute_force_from_the_same_seeds(spark, blobs, k):
    scaled = clusters.scale(blobs, ["id"])
    start = clusters.seeds(scaled, k)
    got = clusters.cluster(scaled, k, rounds=200)
    rows = sorted((r.id, tuple(r.point)) for r in scaled.points.collect())
    centres, near = brute_lloyd([p for _, p in rows], start.tolist())
    assert [tuple(c) for c in got.centres.tolist()] == centres
    assert [r.cluster for r in clusters.assign(got).orderBy("id").collect()] == near
    assert got.sizes == [near.count(i) for i in range(len(centres))]
    last = got.history.filter(f"round = {got.rounds}").orderBy("centre").collect()
    assert [(r.n, list(r.point)) for r in last] == [(n, list(c)) for n, c in zip(got.sizes, centres)]
    resumed = clusters.cluster(scaled, k, rounds=200, start=np.array([list(r.point) for r in got.history.filter("round = 0").orderBy("centre").collect()]))
    assert (resumed.centres == got.centres).all()


def test_clusters_do_not_depend_on_partitions(spark, blobs):
    runs = [clusters.cluster(clusters.scale(df, ["id"]), 4) for df in (blobs, blobs.repartition(13, "y"), blobs.coalesce(1))]
    assert all((r.centres == runs[0].centres).all() and r.inertia == runs[0].inertia for r in runs)


def test_natural_clusters_and_summary(spark, blobs):
    found = clusters.natural_clusters(clusters.scale(blobs.filter("id < 1000"), ["id"]), 5)
    assert clusters.cluster_finding(found) == "Data naturally groups into 3 distinct clusters"
    rows = clusters.summarize(found).collect()
    assert len(rows) == 6 and {r.n for r in rows} == {200} and abs(sum(r.share for r in rows) - 2) < 1e-9
    xs = sorted(r.centre for r in rows if r.column == "x")
    assert all(abs(a - b) < 0.4 for a, b in zip(xs, (0, 3, 10)))


def test_clusters_of_odd_tables(spark):
    make = lambda rows: clusters.scale(spark.createDataFrame(rows, "id long, x double, y double"), ["id"])
    assert clusters.summarize(clusters.cluster(make([]), 3)).count() == 0
    same = clusters.cluster(make([(i, 2.0, 2.0) for i in range(20)]), 3)
    assert same.sizes == [20] and same.inertia == [0]
    got = clusters.cluster(make([(1, 1.0, None), (2, math.nan, 1.0), (3, math.inf, 1.0), (4, 1.0, 2.0), (5, 1.0, 3.0), (None, 1.0, 3.0)]), 2)
    assert sorted(got.sizes) == [1, 2]


def test_mutual_information_of_known_tables(spark):
    rows = [(i % 4, (i % 4) // 2, i // 4 % 2, "ab"[i % 2], 1.0) for i in range(64)]
    df = spark.createDataFrame(rows, "x int, half int, free int, letter string, same double")
    found = {(r.target, r.feature): r for r in importance.feature_importance(df).collect()}
    assert len(found) == 20
    assert abs(found["half", "x"].importance - (math.log(2) - 3 / 128) / math.log(2)) < 1e-9 and found["half", "x"].rank == 1
    assert found["x", "free"].mi == 0 and found["same", "x"].importance == 0 and found["letter", "x"].rank == 1
    text = {r.target: r.finding for r in importance.importance_findings(importance.feature_importance(df)).collect()}
    assert text["letter"] == "x identified as most significant predictor" and "same" not in text


def test_mutual_information_equals_brute_force_with_gaps(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), rng.random() if rng.random() < 0.8 else None, rng.choice(["u", "v", None])) for _ in range(500)]
    rows += [(math.nan, 0.5, "u"), (math.inf, 0.5, "v"), (0.0, None, None)]
    got = importance.mutual_information(importance.joint_histogram(spark.createDataFrame(rows, "a double, b double, c string"), bins=8))
    xs = [r[0] for r in rows if math.isfinite(r[0])]
    ys = [r[1] for r in rows if r[1] is not None]
    cut = lambda v, vs: None if v is None or not math.isfinite(v) else min(7, math.floor((v - min(vs)) / (max(vs) - min(vs)) * 8))
    bins = [(cut(a, xs), cut(b, ys), c) for a, b, c in rows]
    for r in got.collect():
        i, j = "abc".index(r.col1), "abc".index(r.col2)
        pairs = [(x[i], x[j]) for x in bins if x[i] is not None and x[j] is not None]
        n, joint, left, right = len(pairs), Counter(pairs), Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
        assert r.n == n and abs(r.mi - sum(m / n * math.log(m * n / (left[p] * right[q])) for (p, q), m in joint.items())) < 1e-9


def test_importance_of_empty_tables(spark):
    assert importance.feature_importance(spark.createDataFrame([], "a double, b string")).count() == 0
    assert importance.feature_importance(spark.createDataFrame([(1.0,)], "a double")).count() == 0


def test_rounds_read_packed_points_and_draws_pass_few_rows_on(spark, monkeypatch):
    rows = [(i, float(i % 997), float(i * 7919 % 1009)) for i in range(12_000)]
    scaled = clusters.scale(spark.createDataFrame(rows, "id long, x double, y double").repartition(3), ["id"])
    assert scaled.blocks.count() <= 12_000 // 700 + 6  # a round has no step for each row
    centres = np.array([[0, 0], [1 << 20, 1 << 19], [1 << 18, 1 << 20]])
    want = {}
    for r in scaled.points.collect():
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(r.point, c)) for c in centres]
        n, inertia, sums = want.get(d.index(min(d)), (0, 0, [0, 0]))
        want[d.index(min(d))] = n + 1, inertia + min(d), [s + p for s, p in zip(sums, r.point)]
    assert clusters._round(scaled, centres) == want


def test_scaled_values_are_rounded_half_up(spark):
    values = [0.0, 0.5, 1.5, 2.5, 0.49999999999999994, 7.000000001, float(clusters.GRAIN)]
    scaled = clusters.scale(spark.createDataFrame(list(enumerate(values)), "id long, x double"), ["id"])
    assert [r.point[0] for r in scaled.points.orderBy("id").collect()] == [0, 1, 2, 3, 0, 7, clusters.GRAIN]
