import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tabsight.llm import ann

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType())])


def brute(rows, every=50, k=5):
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in (i for i in good if i % every == 0):
        scored = sorted((-float(good[q] @ v / math.sqrt(good[q] @ good[q]) / math.sqrt(v @ v)), i) for i, v in good.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_on_the_whole_table(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in emb.collect()]
    want, got = brute(rows), found(ann.neighbours_of_sample(emb))
    assert set(got) == set(want) and recall(got, want) >= 0.95
    score = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(abs(score[q, i] - s) < 1e-12 for q, g in got.items() for i, s in g if (q, i) in score)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 260)]
    rows += [(1000 + i, rows[49][1]) for i in range(300)]  # copies of vector 50, a query
    rows += [(2000, [0.0] * 8), (2050, None), (2100, []), (2150, [float("nan")] * 8), (2200, [float("inf")] + [1.0] * 7), (None, [1.0] * 8),
             (2250, [None] + [1.0] * 7), (3000, [1e-20] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    want, got = brute(rows), found(ann.neighbours_of_sample(df))
    assert set(got) == set(want)
    assert [i for i, _ in got[50]] == [1000, 1001, 1002, 1003, 1004]
    assert recall(got, want) >= 0.9


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], ""), (0, [1.0, 0.0], "")], SCHEMA)
    assert ann.neighbours_of_sample(one).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0], ""), (3, [1.0, 1.0], ""), (7, [0.0, 2.0], "")], SCHEMA)
    assert {q: [i for i, _ in g] for q, g in found(ann.neighbours_of_sample(three)).items()} == {0: [3, 7]}
    assert ann.neighbours_of_sample(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_graph_reaches_every_point(n):
    x = ann.unit(np.random.default_rng(n).normal(size=(n, 16)))
    members, links = ann.build(x)
    got = ann.search(x, members, links, x, 8)
    assert (got[:, 0] == np.arange(n)).mean() > 0.98
