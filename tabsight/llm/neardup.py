"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

Documents with equal shingle sets form a class.  A class has a signature of ``COORDINATES``
minima and is posted under (coordinate, value) pairs.  Two classes that agree in at least
``MATCHES`` coordinates share one of their first ``COORDINATES - MATCHES + 1`` pairs in any
order of all pairs, so only this prefix is posted; the order puts pairs that are frequent in
a bounded sample last, which only shortens the lists.  Merging the lists skips what cannot
match: other set sizes, and sketches (one bit per coordinate) that differ in too many bits.

A list of n classes is not expanded into its pairs.  First every class is compared with the
list's pivot, the class that shares most; what links becomes a component.  Then only
lists that still hold several components are merged again, the members outside the list's
largest component against all the others, so links between different texts are kept while a
large group of near copies costs about one comparison each.  That second merging counts
common shingles in blocks inside tasks and gives out confirmed links only, since copies that
were edited a little too much can be many.  Agreements are counted on the
signatures, and links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import forget, fresh, materialize, named_id, parts, whole_id
from tabsight.llm.graph import components
from tabsight.llm.words import WordHashes, shingle_set

COORDINATES = 64
# two sets at similarity 0.75 agree in 48 of 64 coordinates on average (deviation 3.5): fewer than 32 once in a million
MATCHES = 32
PREFIX = COORDINATES - MATCHES + 1
# bits of equal coordinates are equal, others by chance: 56 equal bits on average at 0.75 (deviation 2.6), 44 is 4.5 below
SKETCH_DIFFERENT = 20
SIMILAR = 75  # per cent
BLOCK = 128  # members per side of a block
ORDER_SAMPLE = 50_000  # classes whose pairs set the order of pairs; any order gives the same links
_RNG = np.random.default_rng(20_240_601)
_MULTIPLY = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_STEP = 4096


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash over a non-empty set, 32 bits each."""
    best = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(shingles), _STEP):  # long texts in steps, so that memory stays small
        drawn = shingles[start : start + _STEP, None] * _MULTIPLY[None, :] + _ADD[None, :]
        best = np.minimum(best, drawn.min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        n, high, low, signatures = [], [], [], []
        for text in pdf["text"]:
            shingles = shingle_set(text, hashes)
            n.append(len(shingles))
            if len(shingles):
                key = xxhash.xxh3_128_intdigest(shingles.tobytes())
                high.append((key >> 64) - (1 << 63))
                low.append((key & ((1 << 64) - 1)) - (1 << 63))
                signatures.append(signature(shingles).view(np.int32))
            else:
                high.append(None)
                low.append(None)
                signatures.append(None)
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "nameless": pdf["nameless"], "h": pdf["h"], "n": np.asarray(n, dtype=np.int64),
            "k1": pd.array(high, dtype="Int64"), "k2": pd.array(low, dtype="Int64"), "sig": signatures,
        })


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, k1, k2, sig): set size, set key and signature per row; h is a hash of the text."""
    rows = docs.select(*whole_id(F.col("doc_id")), F.xxhash64("text").alias("h"), "text")
    found = rows.mapInPandas(_describe, "doc_id long, nameless boolean, h long, n long, k1 long, k2 long, sig array<int>")
    return found.withColumn("doc_id", named_id()).drop("nameless")


def _frequent(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are frequent in a bounded sample of classes, sorted, with their counts."""
    every = max(1, -(-classes.count() // ORDER_SAMPLE))
    sample = classes.filter(F.pmod(F.xxhash64("k1", "k2"), F.lit(every)) == 0)
    pairs = sample.select(F.posexplode("sig").alias("at", "value")).groupBy("at", "value").count()
    # at most ORDER_SAMPLE * COORDINATES / 25 pairs
    found = pairs.filter(F.col("count") >= 25).toPandas()
    token = (found["at"].to_numpy(np.uint64) << np.uint64(32)) | found["value"].to_numpy(np.int32).view(np.uint32).astype(np.uint64)
    order = np.argsort(token)
    return token[order], found["count"].to_numpy(np.uint64)[order]


def postings(classes: DataFrame) -> DataFrame:
    """(token, node, n, sketch): the prefix of each class's coordinate-value pairs."""
    known, counts = _frequent(classes)
    at = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    shift = np.arange(COORDINATES, dtype=np.uint64)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            values = np.stack(pdf["sig"].to_numpy()).view(np.uint32).astype(np.uint64)
            tokens = values | at
            common = np.zeros(tokens.shape, dtype=np.uint64)
            if len(known):
                where = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                common = np.where(known[where] == tokens, counts[where], 0).astype(np.uint64)
            scattered = (tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            rank = np.argsort((common << np.uint64(44)) | scattered, axis=1, kind="stable")[:, :PREFIX]
            sketch = ((values & np.uint64(1)) << shift).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({
                "token": np.take_along_axis(tokens, rank, axis=1).ravel().astype(np.int64),
                "node": np.repeat(pdf["node"].to_numpy(), PREFIX), "n": np.repeat(pdf["n"].to_numpy(), PREFIX),
                "sketch": np.repeat(sketch, PREFIX),
            })

    return classes.select("node", "n", "sig").mapInPandas(post, "token long, node long, n long, sketch long")


def _may_match(n1: Column, n2: Column, s1: Column, s2: Column) -> Column:
    sizes = (n1 * 100 >= n2 * SIMILAR) & (n2 * 100 >= n1 * SIMILAR)
    return sizes & (F.bit_count(s1.bitwiseXOR(s2)) <= SKETCH_DIFFERENT)


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``MATCHES`` coordinates."""
    one = classes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return pairs.join(one, "a").join(two, "b").filter(same >= MATCHES).select("a", "b")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "shingles": [shingle_set(t, hashes).tobytes() for t in pdf["text"]]})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = np.zeros(len(pdf), dtype=bool)
        for i, (x, y) in enumerate(zip(pdf["xa"], pdf["xb"])):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(two) < len(one):
                one, two = two, one
            where = np.minimum(np.searchsorted(two, one), len(two) - 1)
            both = int((two[where] == one).sum())
            keep[i] = 100 * both >= SIMILAR * (len(one) + len(two) - both)
        yield pdf.loc[keep, ["a", "b"]]


def _class_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): the text of one row of each of these classes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    place = nodes.join(classes.select("node", "rep"), "node")
    met = place.join(texts, place["rep.doc_id"].eqNullSafe(texts["d"]) & (place["rep.h"] == texts["h"]))
    # a row that is repeated gives its text more than once
    return met.select("node", "text").dropDuplicates(["node"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets have a similarity of 0.75 or more, written once."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(_class_texts(wanted, classes, docs).mapInPandas(_sets, "node long, shingles binary"), "sets")
    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
    links = materialize(full.mapInPandas(_confirm, "a long, b long"), "links")
    forget(sets)
    return links


def _star(lists: DataFrame) -> DataFrame:
    """Each class of a list against the class that shares most with others, at its best list."""
    weight = lists.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = lists.join(weight, "node")
    pivot = weighed.groupBy("token").agg(F.max(F.struct("weight", "node", "n", "sketch")).alias("p"))
    near = lists.join(pivot, "token").filter(F.col("node") != F.col("p.node"))
    near = near.filter(_may_match(F.col("n"), F.col("p.n"), F.col("sketch"), F.col("p.sketch")))
    return near.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _families(lists: DataFrame, grouped: DataFrame) -> DataFrame:
    """(family, node, component, few): who may link with another component, by the family they may meet in.

    Only lists that hold several components count.  A family is named by the largest component
    of a list; ``few`` marks members outside of it.  A member takes part if some list holds one
    of the other side that fits it in size and sketch; the semi joins give out no pairs.
    """
    labelled = lists.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tallies = labelled.groupBy("token", "component").agg(F.count("*").alias("members"))
    mixed = tallies.groupBy("token").agg(F.count("*").alias("kinds"), F.max(F.struct("members", "component")).alias("top"))
    mixed = mixed.filter("kinds > 1").select("token", F.col("top.component").alias("family"))
    mine = materialize(labelled.join(mixed, "token").select("token", "family", "node", "component", "n", "sketch"), "lists")
    mine = mine.withColumn("few", F.col("component") != F.col("family"))
    other = mine.select("token", F.col("component").alias("c"), F.col("n").alias("m"), F.col("sketch").alias("s"), F.col("few").alias("f"))
    fits = (mine["token"] == other["token"]) & (F.col("component") != F.col("c")) & _may_match(F.col("n"), F.col("m"), F.col("sketch"), F.col("s"))
    meets = mine.filter("few").join(other, fits, "left_semi").unionByName(
        mine.filter("not few").join(other.filter("f"), fits, "left_semi"))
    return meets.select("family", "node", "component", "few").distinct()


def _compare_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the two sides of each (family, bx, by), whose rows stand together."""
    held: list[pd.DataFrame] = []
    key = ["family", "bx", "by"]
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[key].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        if held and (values[0] != held[0][key].iloc[0].to_numpy()).any():
            yield _links(pd.concat(held))
            held = []
        starts = [0, *cuts.tolist(), len(pdf)]
        for low, high in zip(starts[:-1], starts[1:]):
            held.append(pdf.iloc[low:high])
            if high < len(pdf):
                yield _links(pd.concat(held) if len(held) > 1 else held[0])
                held = []
    if held:
        yield _links(pd.concat(held))


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    left = pdf["side"].to_numpy() == 0
    one, two = pdf[left], pdf[~left]
    found: list[tuple[int, int]] = []
    if len(one) and len(two):
        sets = [np.frombuffer(x, np.uint64) for x in two["shingles"]]
        sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        by = np.argsort(values, kind="stable")
        values, owner = values[by], np.repeat(np.arange(len(sets)), sizes)[by]
        node, component, major = two["node"].to_numpy(), two["component"].to_numpy(), two["family"].to_numpy() == two["component"].to_numpy()
        for x, c, raw in zip(one["node"], one["component"], one["shingles"]):
            mine = np.frombuffer(raw, np.uint64)
            low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, "right")
            hits = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            near = (100 * both >= SIMILAR * (len(mine) + sizes - both)) & (component != c) & (major | (node > x))
            found += [(min(x, y), max(x, y)) for y in node[near].tolist()]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links_across(lists: DataFrame, grouped: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links between components that meet in a list, written once.

    Members outside a family's largest component are compared with all its members, block by
    block, so that a large family becomes many tasks; intersections are counted from shared
    shingles, and only links leave a task.
    """
    families = materialize(_families(lists, grouped), "families")
    sets = materialize(_class_texts(families.select("node").distinct(), classes, docs).mapInPandas(_sets, "node long, shingles binary"), "sets")
    sizes = families.groupBy("family").agg(
        F.ceil(F.count_if("few") / BLOCK).cast("int").alias("nx"), F.ceil(F.count("*") / BLOCK).cast("int").alias("ny"))
    placed = families.join(sizes, "family")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    x = placed.filter("few").select("family", "node", "component", own("nx").alias("bx"), F.explode(every("ny")).alias("by"), F.lit(0).alias("side"))
    y = placed.select("family", "node", "component", F.explode(every("nx")).alias("bx"), own("ny").alias("by"), F.lit(1).alias("side"))
    sides = x.unionByName(y).join(sets, "node")
    blocks = sides.repartition(parts(docs.sparkSession), "family", "bx", "by").sortWithinPartitions("family", "bx", "by")
    links = materialize(blocks.mapInPandas(_compare_blocks, "a long, b long").distinct(), "links")
    forget(sets)
    return links


def classes_of(described: DataFrame) -> DataFrame:
    """(node, k1, k2, n, sig, rep): one row per distinct shingle set, numbered in a written table."""
    grouped = described.filter("n > 0").groupBy("k1", "k2").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("doc_id", "h")).alias("rep"))
    return materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked with another."""
    posted = postings(classes)
    shared = posted.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    lists = materialize(posted.join(shared, "token"), "lists")
    first = materialize(agreeing(_star(lists), classes), "pairs")
    links = confirm(first, classes, docs)
    grouped = materialize(components(links), "components")
    further = links_across(lists, grouped, classes, docs)
    if further.isEmpty():
        return grouped
    return materialize(components(links.unionByName(further)), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, component_id): the component of every row, named by its smallest doc_id.

    A null or wordless text has size 0 and is linked with nothing.  Rows that repeat a text
    share a class.  A null doc_id is a row without a name: it never names a component unless
    all its members are nameless, and then the component is null.  Other columns are ignored;
    an empty table gives no rows.
    """
    described = materialize(describe(docs), "described")
    classes = classes_of(described)
    grouped = linked_classes(docs, classes)
    named = classes.select("node", "k1", "k2", F.col("rep.doc_id").alias("first")).join(grouped, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    # the class's own smallest name ignores nulls, which sort first in a struct
    names = described.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    named = named.drop("first").join(names, ["k1", "k2"])
    tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = named.join(tops, "component").select("k1", "k2", "component", "component_id")
    rows = described.select("doc_id", "h", F.col("n").alias("n_shingles"), "k1", "k2")
    # a large class meets one row per class: adaptive execution broadcasts it or splits the class
    return rows.join(labelled, ["k1", "k2"], "left").select(
        "doc_id", "h", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component")


def duplicate_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document per component: the smallest doc_id, then text hash.

    Rows without words stay.  Of rows equal in doc_id and text one stays.
    """
    found = near_duplicates(docs)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")
    chosen = found.filter("n_shingles > 0").groupBy("component").agg(F.min(key).alias("key"), F.count("*").alias("rows"))
    stay = chosen.select("key.doc_id", "key.h", "rows").unionByName(
        found.filter("n_shingles = 0").select("doc_id", "h", F.lit(1).cast("long").alias("rows")).distinct())
    d, h, n = fresh(docs, "_kept_id"), fresh(docs, "_kept_hash"), fresh(docs, "_group_rows")
    stay = materialize(stay.select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("rows").alias(n)), "stay")
    met = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)))
    once = met.filter(F.col(n) == 1).select(*[docs[c] for c in docs.columns])
    repeated = met.filter(F.col(n) > 1).dropDuplicates([d, h]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(repeated)
