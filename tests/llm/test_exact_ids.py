"""64-bit ids beside a null in one batch, and columns of all types, come back unchanged."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F, types as T

from tabsight.llm import extraction, langid, merkle, mixing, neardup, sharding, substrings, toxicity, wavelet

IDS = [(1 << 53) + 1, (1 << 60) + 1, (1 << 60) + 3, -(1 << 62) - 1, None]
TEXTS = ["one two three four five six seven", "red blue green black white grey", "die der und das mit von sich", "le les des et une dans pour", "no name at all here today"]


@pytest.fixture
def docs(make_docs):
    return make_docs(list(zip(IDS, TEXTS))).coalesce(1)


def ids_of(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


WANT = sorted(IDS, key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("run", [
    lambda d: toxicity.score_documents(d, toxicity.fit(["a b", "idiot scum"] * 40, [0, 1] * 40, epochs=1)),
    neardup.duplicate_report, wavelet.token_digest, substrings.dedup_substrings, sharding.shard_documents, merkle.manifest_documents,
    lambda d: langid.label_documents(d, None),
], ids=["op5", "op6", "op7", "op8", "op10", "op12", "op13"])
def test_ids(docs, run):
    assert ids_of(run(docs)) == WANT


def test_names_of_components(make_docs):
    got = neardup.duplicate_report(make_docs([(i, TEXTS[0]) for i in IDS[1:3]] + [(None, "other words"), (IDS[0], TEXTS[1])]).coalesce(1)).collect()
    named = {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id}
    assert named == {IDS[1]: (IDS[1], True), IDS[2]: (IDS[1], False), IDS[0]: (IDS[0], True)}


def test_pages(spark):
    pages = spark.createDataFrame([(i, "u", f"<article><p>{t}</p></article>") for i, t in zip(IDS, TEXTS)], "page_id long, url string, html string").coalesce(1)
    trees = extraction.fit([f"<html><body><nav>a b</nav><article><p>{t}. {t}.</p></article></body></html>" for t in TEXTS])
    got = extraction.main_text(pages, trees)
    assert sorted((r.page_id for r in got.collect()), key=lambda i: (i is None, i or 0)) == WANT


def test_stages_leave_other_columns_alone(spark):
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("price", T.DecimalType(30, 10)),
        T.StructField("at", T.TimestampType()), T.StructField("tags", T.MapType(T.StringType(), T.LongType())),
        T.StructField("inner", T.StructType([T.StructField("big", T.LongType())])), T.StructField("raw", T.BinaryType())])
    rows = [(i, t, "en", "s", None if n == 1 else (1 << 60) + n, decimal.Decimal("12345678901234567890.0123456789"),
             datetime.datetime(2020, 1, 1, 2, 3, 4, 567891), {"k": (1 << 60) + 1, "none": None}, ((1 << 60) + 7,), b"\x00\xff")
            for n, (i, t) in enumerate(zip(IDS, TEXTS))]
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    model = toxicity.fit(["a b", "idiot scum"] * 40, [0, 1] * 40, epochs=1)
    model.thresholds = dict.fromkeys(toxicity.LANGUAGES, 100.0)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    want = sorted(docs.collect(), key=key)
    assert sorted(toxicity.keep_clean(docs, model).collect(), key=key) == want
    assert sorted(neardup.keep_one(docs).collect(), key=key) == want
    assert sorted(sharding.shard_rows(docs).select(*docs.columns).collect(), key=key) == want


def test_rates_above_one_draw(spark, make_docs):
    docs = make_docs([(i, "x" * 100, "small" if i < 2 else "big") for i in range(1000)])
    rates = {r.source: r.rate for r in mixing.source_rates(docs, "source", "text", {"small": 1.0, "big": 0.0}, size=200_000.0).collect()}
    assert rates["small"] == 1000.0
    got = [r["count"] for r in mixing.replicate(docs, weights={"small": 1.0}, size=200_000.0).groupBy("doc_id").count().collect()]
    assert len(got) == 2 and all(abs(n - 1000) < 160 for n in got)  # five deviations
    copies = [r.copy for r in mixing.replicate(docs, weights={"small": 1.0}, size=200_000.0).filter("doc_id = 0").collect()]
    assert sorted(copies) == list(range(len(copies)))
