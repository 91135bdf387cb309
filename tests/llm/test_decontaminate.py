import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from tabsight.llm import decontaminate as dc

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item", T.StringType())])


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    """(doc, item) -> largest similarity over all item-sized windows."""
    out = {}
    for i, it in items:
        w = words(it)
        if len(w) < 5:
            continue
        bag = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for d, t in docs:
            v = words(t)
            size = min(len(w), len(v))
            for s in range(max(0, len(v) - size) + 1) if size >= 5 else ():
                own = Counter(tuple(v[k : k + 5]) for k in range(s, s + size - 4))
                both = sum((own & bag).values())
                sim = both / (sum(own.values()) + sum(bag.values()) - both)
                if sim >= 0.75:
                    out[d, i] = max(out.get((d, i), 0), round(sim, 9))
    return out


def run(spark, docs, items):
    return {(r.doc_id, r.item_id): r.similarity for r in dc.leak_report(docs, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)).collect()}


def test_leaks_edits_and_borders(spark, make_docs):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(12)] + [(50, "too few words"), (51, None), (52, ""), (53, "la la " * 20)]
    docs = [(0, None), (1, ""), (2, "a b c"), (3, text(400)), (4, "la " * 500), (9, "la " * 1500)]
    for i in range(60):
        w = items[i % 12][1].split()
        for _ in range(i % 4):  # replaced words
            w[rng.randrange(len(w))] = "zz"
        if i % 5 == 0:
            del w[rng.randrange(len(w))]
        inner = " ".join(w)
        docs.append((10 + i, [inner, inner.upper() + "!", f"{text(50)}. {inner}, {text(9)}", f"{inner} {text(30)}"][i % 4]))
    docs += [(100, " ".join(items[0][1].split()[:-3])), (101, items[1][1] + " " + items[2][1]), (102, items[3][1] + " " + items[3][1])]
    want, got = brute(docs, items), run(spark, make_docs(docs), items)
    assert set(got) == set(want)
    assert all(got[k] <= v for k, v in want.items()) and all(got[k] == v for k, v in want.items() if v == 1)
    assert {(10 + i, i % 12) for i in range(0, 60, 4) if i % 5} <= set(got)


def test_clean_rows_stay_with_all_columns(spark, make_docs):
    item = "one two three four five six seven eight nine ten"
    docs = make_docs([(1, item), (1, "clean"), (None, f"so {item} it"), (None, None), (3, "clean"), (3, "clean")]).withColumn("_leaked", F.lit(7)).withColumn("KEY", F.lit(8))
    kept = dc.keep_clean(docs, spark.createDataFrame([(1, item, "x"), (1, item, "x")], ITEMS))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), r._leaked) for r in kept.collect()) == [("1", "clean", 7), ("3", "clean", 7), ("3", "clean", 7), ("None", "None", 7)]


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    assert dc.leak_report(make_docs([(1, "a b c d e f")]), none).count() == 0
    assert dc.leak_report(make_docs([]), spark.createDataFrame([(1, "a b c d e f", "")], ITEMS)).count() == 0
    assert dc.keep_clean(make_docs([(1, "a")]), none).count() == 1


@pytest.mark.parametrize("different", [0, 4, 19])
def test_blocks_find_every_print_within_the_radius(different):
    rng = random.Random(different)
    masks = set(map(int, dc._MASKS.split(",")))
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), different):
            b ^= 1 << bit
        assert any((a >> 16 * k ^ b >> 16 * k) & 0xFFFF in masks for k in range(4))


def test_parts_of_an_item_in_another_order(spark, make_docs):
    rng = random.Random(14)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    parts = [text(60) for _ in range(12)]
    items = [(i, " ".join(w)) for i, w in enumerate(parts)]
    docs = []
    for i, w in enumerate(parts):
        docs.append((2 * i, " ".join(text(150) + w[30:] + w[:30] + text(150))))
        docs.append((2 * i + 1, " ".join(text(150) + w[12:] + w[:12] + text(20))))
    want, got = brute(docs, items), run(spark, make_docs(docs), items)
    assert set(want) == {(d, d // 2) for d in range(24)} and got == want
