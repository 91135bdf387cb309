from collections import Counter

import corpus_pipeline
from tabsight.llm import mixing, sharding, toxicity
from tabsight.llm.words import word_shingles


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != "sharding":
            assert out.columns == columns
        ids = {r.doc_id for r in rows}
        assert ids <= set(before) and all(r.text == before[r.doc_id] for r in rows)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {r.doc_id for r in toxicity.score_documents(docs, model).filter("predicted = 0").collect()}
        if name == "near_dedup":
            sets = dict(zip(before, word_shingles(list(before.values()))))
            near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
            assert all(not near(a, b) for a in ids for b in ids if a < b)
            assert all(any(near(g, k) for k in set(before) if k != g) for g in set(before) - ids)
        if name == "decontamination":
            items = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids == {d for d, t in before.items() if not any(i in t.lower() for i in items)}
        if name == "mixing":
            assert 0.5 * len(before) < len(rows) < 1.6 * len(before)
        if name == "sharding":
            slots = {}
            for r in rows:
                slots.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        before = {r.doc_id: r.text for r in rows}
        if name == "mixing":
            assert max(Counter(r.doc_id for r in rows).values()) >= 2
        docs = spark.createDataFrame(rows, out.schema)


def test_mixing_and_sharding_edge_rows(spark, make_docs):
    docs = make_docs([(1, "a", "s"), (1, "a", "s"), (None, None, None), (3, "", "t"), (4, "b" * 5000, "s")]).withColumnRenamed("lang", "copy").withColumnRenamed("n_chars", "Rank")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix(make_docs([])).count() == 0 and mixing.mixed_documents(make_docs([])).count() == 0
    out = sharding.shard_rows(docs.withColumnRenamed("Rank", "slot"))
    assert sorted(out.columns) == sorted(["doc_id", "text", "copy", "source", "shard", "slot"]) and out.count() == 5
    twice = [r.shard for r in out.collect() if r.doc_id == 1]
    assert twice[0] == twice[1]
    assert sharding.shard_rows(make_docs([])).count() == 0


def test_rates_meet_the_targets(spark, make_docs):
    docs = make_docs([(i, "x" * 100, "big" if i % 3 else "small") for i in range(3000)])
    shares = {r.source: r.rate for r in mixing.source_rates(docs, "source", "text", {"big": 1.0, "small": 1.0}).collect()}
    assert abs(shares["big"] - 0.75) < 1e-9 and abs(shares["small"] - 1.5) < 1e-9
    got = Counter(r.source for r in mixing.mixed_documents(docs, {"big": 1.0, "small": 1.0}).collect())
    assert abs(got["big"] - 1500) < 120 and abs(got["small"] - 1500) < 120
    none = Counter(r.source for r in mixing.mixed_documents(docs, {"small": 2.0}).collect())
    assert set(none) == {"small"}


def test_a_new_shard_only_wins(spark):
    keys = spark.range(4000)
    rows = sharding.assign_shards(keys, "id", 10, grown="grown").collect()
    assert all(r.grown in (r.shard, 10) for r in rows)
    assert 250 < sum(r.grown == 10 for r in rows) < 480
    again = {r.id: r.shard for r in sharding.assign_shards(keys, "id", 11).collect()}
    assert all(again[r.id] == r.grown for r in rows)
    weighted = Counter(r.shard for r in sharding.assign_shards(keys, "id", [1.0, 3.0, 0.0]).collect())
    assert weighted[2] == 0 and 0.7 < weighted[1] / 4000 < 0.8


def test_digest_of_shards(spark, sf):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"key"}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard in (r.shard, 40)
