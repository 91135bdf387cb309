import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import langid

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 4 = 1")  # a test on a quarter of the texts
    got = langid.label_documents(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    right = held.lang_pred == held.lang
    assert len(held) > 400 and right.mean() > 0.98
    assert all(right[held.lang == name].mean() > 0.95 for name in ("de", "en", "es", "fr"))
    assert got.score.between(0, 1).all() and (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    model = langid.Model.fresh(["a", "b", "c"])
    windows = rng.integers(97, 123, (langid.STEPS, 5)).astype(np.uint8)
    labels = np.array([0, 1, 2, 0, 1])

    def loss():
        first = np.stack([s for _, s in model.forwards.run(windows, range(langid.STEPS))]).astype(float)
        back = dict(model.backwards.run(windows, range(langid.STEPS - 1, -1, -1)))
        second = np.stack([back[i] for i in range(langid.STEPS)]).astype(float)
        p = np.exp(model.out_forwards @ first + model.out_backwards @ second + model.bias)
        p /= p.sum(axis=1, keepdims=True)
        return -np.log(p[:, labels, np.arange(5)]).mean()

    for part, slope in zip(model.parts(), model.gradients(windows, labels)):
        flat, d = part.reshape(-1), slope.reshape(-1)
        for i in np.argsort(-np.abs(d))[:3]:
            was = flat[i]
            flat[i] = was + 0.01
            up = loss()
            flat[i] = was - 0.01
            assert abs((up - loss()) / 0.02 - d[i]) < 0.03 * abs(d[i]) + 2e-4
            flat[i] = was


def test_windows_cover_every_byte_once():
    for n in (1, langid.CORE, langid.CORE + 1, 5 * langid.CORE + 7):
        data = np.arange(n, dtype=np.uint64).astype(np.uint8) | 1
        rows = langid.cut(data)
        assert (rows[:, langid.REACH : langid.REACH + langid.CORE].ravel()[:n] == data).all()
        assert len(rows) == -(-n // langid.CORE)


def test_a_long_text_is_read_to_its_end(model):
    de, fr = "der und nicht die schung enheit ich ", "le des qui reau ment aire eux la "
    names, scores = langid.predict(model, [de * 9_000 + fr * 30_000, fr * 100, de * 100])
    assert names == ["fr", "fr", "de"] and scores[0] < scores[1]


def test_result_does_not_depend_on_neighbours(model):
    texts = ["Enheit der und " * n for n in (1, 30, 700)] + [None, "", "123 ..."] + ["thing the of " * 40]
    names, scores = langid.predict(model, texts)
    for t, name, score in zip(texts, names, scores):
        alone, s = langid.predict(model, [t])
        assert alone[0] == name and abs(s[0] - score) < 1e-5


def test_edge_rows(spark, make_docs, model):
    big = [(1 << 53) + 1, (1 << 60) + 1, (1 << 60) + 3]
    rows = [(1, None), (2, ""), (3, " 12 — !!"), (None, "the of and"), *[(b, "der die und " * 3) for b in big], (5, "le " * 60_000), (5, "le " * 60_000), (6, "L'ÉTÉ")]
    docs = make_docs(rows).coalesce(1).withColumn("score", F.lit("x")).withColumn("Lang_Pred", F.lit(1))
    got = langid.label_documents(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("de", "en", "es", "fr") for r in got if r.doc_id not in (1, 2, 3))
    assert langid.label_documents(make_docs([]), model).count() == 0
    assert langid.train(make_docs([])) is None
    assert [r.lang_pred for r in langid.label_documents(make_docs([(1, "abc")]), None).collect()] == ["und"]


def test_sample_leaves_the_fold_out_and_is_bounded(spark, make_docs):
    docs = make_docs([(i, f"document{i} text") for i in range(400)]).withColumn("lang", F.when(F.col("doc_id") % 10 > 0, F.lit("x")))
    got = langid.excerpts(docs, 50).toPandas()
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2 or i % 10 == 0}
    assert len(got) == 50 and not any(int(t.split()[0][8:]) in held for t in got.excerpt if t.startswith("document"))
    again = langid.excerpts(docs.repartition(7), 50).toPandas()
    assert sorted(got.excerpt) == sorted(again.excerpt)
