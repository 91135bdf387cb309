"""Benchmark decontamination with SimHash fingerprints of item-sized windows, in DataFrame operations only.

1. A window with few shingles of the benchmark cannot be similar to an item, so the hashed
   shingles of all texts are first met with the benchmark's; where they stand names the windows:
   as long as the item, at every start from which enough of them are inside, in any order.
2. Windows and items get 64-bit SimHash fingerprints, every shingle weighing as often as it
   occurs.  Fingerprints within ``RADIUS`` bits differ in at most a quarter of that in one of
   four blocks, so the index of items under all block values within that distance finds each
   of them.
3. The bags of shingles of what was found are compared exactly: sum of the smaller counts
   over sum of the larger ones.

Words are runs of letters and digits in lower case; a shingle is five of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import fresh, materialize

SHINGLE = 5
SIMILAR = 0.75
# similarity 0.75 makes 11 different bits on average (deviation 3.0); 19 are exceeded in less than one case in 200
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
BROADCAST_SHINGLES = 1_000_000  # 24 bytes each; a larger benchmark is joined by a shuffle

_MASKS = ",".join(str(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def shingles(words_column: str) -> Column:
    """A hash per five consecutive words, in order; none with fewer words."""
    return F.expr(
        f"transform(slice({words_column}, 1, greatest(size({words_column}) - {SHINGLE - 1}, 0)), (_word, _at) -> xxhash64(_word, "
        + ", ".join(f"get({words_column}, _at + {k})" for k in range(1, SHINGLE)) + "))")


def fingerprint(hashes: str) -> Column:
    """SimHash: each bit is the majority of that bit over all shingles, repeats included."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * aggregate({hashes}, 0, (s, h) -> s + CAST(shiftright(h, b) & 1L AS INT))"
        f" > size({hashes}), shiftleft(1L, b), 0L))")


def _blocks(print_column: str) -> Column:
    """(block number, block value) of a fingerprint."""
    return F.expr(
        f"transform(sequence(0, {BLOCKS - 1}), k -> struct(k AS block, CAST(shiftrightunsigned({print_column}, k * {BLOCK_BITS}) & "
        f"{(1 << BLOCK_BITS) - 1}L AS INT) AS value))")


def prepare_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, m, hashes, print), written once; items of fewer than five words match nothing."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    rows = rows.filter(F.size("w") >= SHINGLE).select("item_id", F.size("w").alias("m"), shingles("w").alias("hashes"))
    rows = rows.distinct()
    return materialize(rows.select("*", fingerprint("hashes").alias("print")).withColumn("item", F.monotonically_increasing_id()), "items")


def item_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, places): per text hash, the (start, m, aligned) of windows that can be similar to an item of m words.

    Of W and M shingles at least SIMILAR * (W + M) / (1 + SIMILAR) have to be common, so a window
    with fewer places that hold a shingle of such items cannot be similar to one; all others are
    named, whatever the order of their shingles.  ``aligned`` are those with a common shingle where
    the item has it.
    """
    own = items.select("m", F.posexplode("hashes").alias("q", "hash"))
    count = items.agg(F.sum(F.size("hashes"))).first()[0] or 0
    texts = docs.select(F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    texts = texts.select("key", F.size("w").alias("n"), shingles("w").alias("hashes"))
    # the outer form: else the optimizer filters on the size of the hashes first, and computes them in that filter
    each = texts.select("key", "n", F.posexplode_outer("hashes").alias("pos", "hash"))
    places = own.select("hash", "m", "q").distinct()
    met = each.join(F.broadcast(places) if count <= BROADCAST_SHINGLES else places, "hash")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("q"), F.col("n") - F.col("m")))
    hits = met.groupBy("key", "n", "m").agg(F.sort_array(F.collect_set("pos")).alias("hits"), F.collect_set(start).alias("aligned"))
    hits = hits.withColumn("room", F.least("m", "n") - (SHINGLE - 1))
    need = F.ceil(F.lit(SIMILAR) * (F.col("room") + F.col("m") - (SHINGLE - 1)) / F.lit(1 + SIMILAR) - F.lit(1e-9)).cast("int")
    # the i-th hit is the first in a window that reaches the needed number of hits: from so early to that hit it may start
    starts = F.expr(
        "array_distinct(flatten(transform(filter(sequence(0, greatest(0, size(hits) - need)), i -> get(hits, i + need - 1) - get(hits, i) < room), i -> "
        "sequence(least(greatest(0, get(hits, i + need - 1) - room + 1), greatest(0, n - m)), least(get(hits, i), greatest(0, n - m))))))")
    named = hits.withColumn("need", need).filter(F.size("hits") >= F.col("need")).withColumn("starts", starts)
    named = named.select("key", F.expr("transform(starts, s -> struct(s AS start, m, array_contains(aligned, s) AS aligned))").alias("places"))
    return named.filter(F.size("places") > 0).groupBy("key").agg(F.flatten(F.collect_list("places")).alias("places"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, start_word, n_words, similarity): the best window for each row and item it leaks.

    Every row of ``docs`` is looked at by its text, so null or repeated doc_ids lose nothing;
    null and short texts match nothing; a text shorter than an item is one window.  Without
    documents or items there are no rows.  Other columns are ignored.
    """
    items = prepare_items(benchmark)
    places = materialize(item_windows(docs, items), "windows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_key"),
                        F.xxhash64("text").alias("key"), "text")
    held = texts.join(places, "key").select("doc_id", "text_key", "places", words(F.col("text")).alias("w"))
    held = held.select("doc_id", "text_key", "places", F.size("w").alias("n"), shingles("w").alias("hashes"))
    # each window takes its own slice along, so a long text is not copied for every window
    cut = held.select("doc_id", "text_key", F.inline_outer(F.expr(
        "transform(places, p -> named_struct('start', p.start, 'm', p.m, 'aligned', p.aligned, 'n_words', least(p.m, n), "
        f"'hashes', slice(hashes, p.start + 1, least(p.m, n) - {SHINGLE - 1})))")))
    windows = materialize(cut.select("*", fingerprint("hashes").alias("print")).withColumn("window", F.monotonically_increasing_id()), "prints")

    index = items.select("item", "m", F.col("print").alias("item_print"), F.inline(_blocks("print")))
    index = index.withColumn("mask", F.explode(F.split(F.lit(_MASKS), ",").cast("array<int>")))
    index = index.select("item", "m", "item_print", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    asked = windows.select("window", "m", "print", F.inline(_blocks("print")))
    # the index has some ten thousand rows per item, which the planner cannot see: no side is broadcast
    found = asked.hint("merge").join(index, ["m", "block", "value"]).filter(
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("window", "item").distinct()
    found = materialize(found, "candidates")

    bags = found.join(windows.select("window", F.explode("hashes").alias("hash")), "window").groupBy("window", "item", "hash").agg(
        F.count("*").alias("c"))
    item_bags = items.select("item", F.explode("hashes").alias("hash")).groupBy("item", "hash").agg(F.count("*").alias("ic"))
    both = bags.join(item_bags, ["item", "hash"]).groupBy("window", "item").agg(F.sum(F.least("c", "ic")).alias("both"))
    whole = both.join(windows.select("window", "doc_id", "text_key", "start", "aligned", "n_words", F.size("hashes").alias("size")), "window").join(
        items.select("item", "item_id", F.size("hashes").alias("item_size")), "item")
    similarity = F.col("both") / (F.col("size") + F.col("item_size") - F.col("both"))
    alike = whole.select("doc_id", "text_key", "item_id", F.col("start").alias("start_word"), "aligned", "n_words", similarity.alias("similarity")).filter(
        F.col("similarity") >= SIMILAR)
    # of equally similar windows one is preferred that has a shingle where the item has it
    best = F.max(F.struct("similarity", "aligned", (-F.col("start_word")).alias("start"), "n_words")).alias("best")
    return alike.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", (-F.col("best.start")).alias("start_word"), F.col("best.n_words").alias("n_words"),
        F.round("best.similarity", 9).alias("similarity"))


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) of every document and item it contains."""
    return contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words")).alias("b")).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, all columns as they are."""
    key = fresh(docs, "_leaked")
    leaked = materialize(contaminated(docs, benchmark).select(F.col("text_key").alias(key)).distinct(), "leaked")
    return docs.join(leaked, F.md5(F.col("text").cast("binary")) == F.col(key), "left_anti")


LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, pos, array_to_string(w[pos + 1 : pos + {SHINGLE}], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS pos FROM d)),
bs AS (SELECT item_id, len(w) AS m, q, array_to_string(w[q + 1 : q + {SHINGLE}], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS q FROM b)),
win AS (SELECT DISTINCT ds.doc_id, bs.item_id, bs.m, greatest(0, least(pos - q, n - m)) AS start, least(m, n) AS n_words
        FROM ds JOIN bs USING (s)),
wc AS (SELECT win.doc_id, win.item_id, start, n_words, m, s, count(*) AS c
       FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos BETWEEN start AND start + n_words - {SHINGLE} GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS ic FROM bs GROUP BY ALL),
sim AS (SELECT doc_id, wc.item_id, start, n_words,
               sum(least(c, coalesce(ic, 0))) / (any_value(n_words) - {SHINGLE - 1} + any_value(m) - {SHINGLE - 1} - sum(least(c, coalesce(ic, 0)))) AS similarity
        FROM wc LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.s = wc.s GROUP BY ALL)
SELECT doc_id, item_id, CAST(start AS INT) AS start_word, CAST(n_words AS INT) AS n_words, round(CAST(similarity AS DOUBLE), 9) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sim WHERE similarity >= {SIMILAR})
WHERE r = 1"""
