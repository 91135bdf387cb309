"""Shards, slots and growth against a brute-force draw in Python."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tabsight.llm import sharding


def cost(key, shard, weight=1.0):
    drawn = int(hashlib.md5(f"{key}#{shard}".encode()).hexdigest()[:13], 16)
    return -math.log((drawn + 0.5) / 2.0**52) / weight


def brute(docs, shards):
    rows = []
    for doc_id, text in docs:
        key = "" if doc_id is None else str(doc_id)
        shard = min(range(shards), key=lambda i: (cost(key, i), i))
        grown = shards if cost(key, shards) < cost(key, shard) else shard
        body = (text or "").encode()
        rows.append([doc_id, len(body) + 16, zlib.crc32(body), "key", shard, grown])
    slots, out = {}, []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        slot = slots.get(row[4], 0)
        slots[row[4]] = slot + 1
        out.append((*row[:5], slot, row[5]))
    return sorted(out, key=repr)


def found(docs, shards):
    got = sharding.shard_documents(docs, shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert found(docs, 40) == brute([tuple(r) for r in docs.collect()], 40)


@pytest.mark.parametrize("shards", [1, 7])
def test_odd_rows(spark, shards):
    rows = [(None, "no id"), (None, None), (5, None), (5, None), (6, ""), (7, "é漢" * 9), ((1 << 60) + 1, "x"), ((1 << 60) + 3, "x"), (-4, "y " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit("other") for c in ("shard", "slot", "size", "rank", "row")}).repartition(4)
    assert found(clashing, shards) == brute(rows, shards)
    assert found(docs.limit(0), shards) == []


def test_weights_and_growth(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    got = sharding.assign_shards(docs, "doc_id", [3.0, 0.0, 1.0], grown_weight=2.0, grown="grown").collect()
    counts = [sum(r["shard"] == i for r in got) for i in range(3)]
    assert counts[1] == 0 and abs(counts[0] - 3000) < 150
    moved = [r for r in got if r["grown"] != r["shard"]]
    assert all(r["grown"] == 3 for r in moved) and abs(len(moved) - 4000 / 3) < 150
