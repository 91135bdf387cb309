import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import neardup
from tabsight.llm.graph import components
from tabsight.llm.words import WordHashes, shingle_hashes, word_shingles, words_of


def brute(rows):
    """doc_id -> (set size, smallest doc_id reachable) by comparing every pair."""
    sets = word_shingles([t for _, t in rows])
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def report(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.duplicate_report(docs).collect()}


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert report(docs) == brute(rows)


def test_group_of_near_copies_and_copies(make_docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(120):  # edits put copies just above and below the threshold to each other
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(500 + i, " ".join(base)) for i in range(60)]
    rows += [(900 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(40)]
    assert report(make_docs(rows)) == brute(rows)


def test_edge_cases(make_docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three four five"), (7, "Été"),
            (8, "été"), (9, "word " * 30_000), (10, "word " * 40_000)]
    assert report(make_docs(rows)) == brute(rows)
    assert report(make_docs([])) == {}


def test_repeated_and_nameless_rows(make_docs):
    text = " ".join(f"a{i}" for i in range(30))
    docs = make_docs([(3, text), (3, text), (None, text), (5, text + " end"), (7, None), (7, None), (None, "alone here")])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.duplicate_report(docs).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("5", "3", False), ("7", "7", True), ("7", "7", True),
                   ("None", "3", False), ("None", "None", True)]
    crowded = docs.withColumn("_h", F.lit(1)).withColumn("component", F.lit(2)).withColumn("Sig", F.lit(3))
    kept = sorted((str(r.doc_id), str(r.text), r._h) for r in neardup.keep_one(crowded).collect())
    assert kept == [("3", text, 1), ("7", "None", 1), ("7", "None", 1), ("None", "alone here", 1)]


def test_words_and_shingles():
    assert words_of("A\x0bb C \x1cd\r\nÄ") == [b"a", "b c".encode(), b"\x1cd", "Ä".encode()]
    h = WordHashes()
    assert len(shingle_hashes(h.of(words_of("a b c d e f")))) == 2
    assert len(shingle_hashes(h.of(words_of("a b")))) == 1
    assert shingle_hashes(h.of(words_of("a b")))[0] != shingle_hashes(h.of(words_of("b a")))[0]


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path_a_star_and_loops(spark, n):
    order = np.random.default_rng(n).permutation(n + 1).tolist()
    links = [(order[i], order[i + 1]) for i in range(n)] + [(1000, 1000 + i) for i in range(n)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: 0 for x in range(n + 1)} | {1000 + i: 1000 for i in range(n)} | {5000: 5000}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
