import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabsight.llm import merkle
from tests.llm.conftest import DOCS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    shown = (None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text))
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def grow(nodes):
    """All levels of a tree, from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 3 * 3
        out.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return out


def brute(rows):
    """Expected rows of the contract from (doc_id, text, lang, source, n_chars) rows."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[name] = (ordered, grow([leaf(*r) for r in ordered]))
    top = grow([trees[name][1][-1][0] for name in names])
    root = top[-1][0] if names else None
    out = []
    for j, name in enumerate(names):
        ordered, levels = trees[name]
        for i, r in enumerate(ordered):
            path = siblings(levels, i) + siblings(top, j)
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            value = leaf(r[0], r[1].replace("\n", "") if tampered else r[1], *r[2:])
            for left, right in path:
                value = h(*left, value, *right)
            out.append((r[0], leaf(*r), levels[-1][0], root, h(*[d for p in path for side in p for d in side]), value, value == root))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.fixture(params=[6, 1])
def levels(request, monkeypatch):
    """Blocks as they are, and of three leaves: then every tree takes many rounds."""
    monkeypatch.setattr(merkle, "LEVELS", request.param)
    monkeypatch.setattr(merkle, "BLOCK", 3**request.param)
    return request.param


def test_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = merkle.manifest_documents(docs).collect()
    same(got, brute([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]))
    assert 0.1 < sum(not r.verified for r in got) / len(got) < 0.6


def test_edge_rows(spark, levels):
    big = [(1 << 53) + 1, (1 << 60) + 1, (1 << 60) + 3]
    rng = random.Random(4)
    rows = [(i, f"line {i}\nnext" * rng.randint(1, 3), "en", "hot", 7) for i in range(0, 90, 2)]
    rows += [(b, "a\nb", None, "hot", None) for b in big] + [(None, "x\ny", "en", "hot", 3), (None, None, None, None, None), (4, "\n", "é", "", 1)]
    rows += [(5, "", "fr", "Zoë", 0), (5, "", "fr", "Zoë", 0), (6, None, "fr", "alone", 2), (7, "word\n" * 60_000, "fr", None, 2)]
    rows += [(100 + i, "t\n", "de", f"s{i}", 2) for i in range(11)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("x")).withColumn("Digest", F.lit(1)).withColumn("tree", F.lit(0))
    same(merkle.manifest_documents(docs).collect(), brute(rows))


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_one_source(spark, levels, count):
    if levels == 6 and count > 4:
        pytest.skip("one block")
    rows = [(i, f"a\n{i}", "en", "s", 3) for i in range(count)]
    same(merkle.manifest_documents(spark.createDataFrame(rows, DOCS)).collect(), brute(rows))


def test_a_source_of_many_blocks(spark):
    rows = [(i, f"a\n{i}", "en", "hot" if i % 3 else f"s{i % 7}", 3) for i in range(4000)]
    same(merkle.manifest_documents(spark.createDataFrame(rows, DOCS)).collect(), brute(rows))


def test_manifest_and_proofs(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}", 6) for i in range(50)]
    leaves = spark.createDataFrame([(r[3], r[0], leaf(*r)) for r in rows], "source string, doc_id long, digest string")
    made = merkle.build(leaves, ["doc_id"])
    assert {(r.source, r.n) for r in made.subroots.collect()} == {("s0", 13), ("s1", 13), ("s2", 12), ("s3", 12)}
    at = {(r.tree, r.idx): r for r in made.leaves.collect()}
    proofs = made.proofs().collect()
    assert len(proofs) == 50
    for p in proofs:
        value = at[p.tree, p.idx].digest
        assert merkle.fold(value, merkle.path_of(p.lefts, p.rights)) == made.root
        assert merkle.fold(h(value), merkle.path_of(p.lefts, p.rights)) != made.root


def test_the_queue_stays_small(monkeypatch):
    sizes = []
    push = merkle.heappush
    monkeypatch.setattr(merkle, "heappush", lambda q, m: (push(q, m), sizes.append(len(q)))[0])
    rows = merkle.climb([h(str(i)) for i in range(729)], 6)
    assert [len(r) for r in rows] == [729, 243, 81, 27, 9, 3, 1] and max(sizes) <= 2 * 6 + 1
    merkle.deliver(rows, ())
    assert max(sizes) <= 3 * 6 + 1
