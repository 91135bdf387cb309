"""Exact repeated substrings by depth-limited most-significant-digit passes.

Every window of ``DEPTH`` bytes is ordered through that depth only, and only as long as it
may still be repeated:

1. The first digit of a window is its least ``DIGIT``-byte string (by hash, leftmost), the
   *anchor*.  Equal windows have equal anchors at equal places, and neighbouring windows
   share theirs, so one row stands for some thirty-five windows.  Anchors seen once are done.
2. The second digit is everything that the windows of an anchor can cover.  Where all
   occurrences agree in it, all their windows are equal, and all but the earliest are repeats.
3. The third digit is one half of that: windows that start up to ``SPLIT`` bytes before their
   anchor hold the same bytes after it, the others the same bytes before it.  Where a half
   occurs in one context only, its windows are done; and so are those of a context that came before.
4. What is left, in the first occurrences of contexts, differs somewhere inside: those windows are sorted
   through all ``DEPTH`` bytes, and equal groups are exactly the repeated windows.

Documents lie in ranges of doc_id in a bucketed table, so that each pass reads them in place.
A bucket settles its own repeats and sends each digit once, so a string with very many
occurrences costs one row per bucket and pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.llm.common import clean_shuffles, forget, fresh, materialize, mix64, named_id, parts, scratch_path, tables, total_bytes, whole_id

DEPTH = 100  # bytes of a repeated string
DIGIT = 32  # bytes of an anchor: long enough not to recur by chance, short enough to stand for many windows
REACH = DEPTH - DIGIT  # how far before an anchor its windows may start
SPLIT = REACH // 2
BUCKET_BYTES = 8 << 20
_PIECE = 1 << 15  # positions at a time: what is computed of them stays in the processor's cache
_ODD = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(32)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _cover(low: int, high: int) -> list[int]:
    """Where ``DIGIT``-byte strings start that together cover the bytes from low up to high."""
    return [*range(low, high - DIGIT, DIGIT), high - DIGIT]


_IN_CONTEXT = _cover(-REACH, DEPTH)
_IN_WINDOW = _cover(0, DEPTH)
_IN_AFTER = _cover(0, DEPTH - SPLIT)
_IN_BEFORE = _cover(-SPLIT - 1, DIGIT)

REPEATED, OPEN, WINDOW, HALF, CONTEXT = 1, 2, 3, 4, 5  # kinds of what a bucket is told


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a number."""
    return np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data, strides=(1,))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` keys, by runs of doubling length."""
    run, have = keys, 1
    while 2 * have <= width:
        run = np.minimum(run[:-have], run[have:])
        have *= 2
    return run if have == width else np.minimum(run[: len(keys) - width + 1], run[width - have :])


def _strings(words: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hash of the ``DIGIT`` bytes from each position from low up to high."""
    n = high - low
    w = words[low : high + DIGIT - 8] * _ODD[0]
    w ^= w >> _SHIFT
    w *= _ODD[1]
    w ^= w >> np.uint64(29)
    out = w[:n] * _ODD[2]
    for j in range(1, DIGIT // 8):
        out += w[8 * j : 8 * j + n] * _ODD[2 + j]
    out ^= out >> _SHIFT
    out *= _ODD[10]
    out ^= out >> _SHIFT
    return out


def _joined(strings: np.ndarray, places: np.ndarray, offsets: list[int], salt: int) -> np.ndarray:
    """One hash of the strings at some offsets from each place."""
    out = np.full(len(places), salt, dtype=np.uint64)
    for j, offset in enumerate(offsets):
        out += strings[places + offset] * _ODD[12 + j]
    return mix64(out)


def _grouped(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, mask): rows with the same key and other key stand together, and which rows begin a group.

    The other key hardly ever differs where the key, a hash of more bytes, does not.
    """
    by = np.argsort(key)
    k, o = key[by], other[by]
    if ((k[1:] == k[:-1]) & (o[1:] != o[:-1])).any():
        by = np.lexsort((other, key))
        k, o = key[by], other[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return by, new


def _least_of(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The least value of each group, given where the groups begin."""
    return np.minimum.reduceat(values, heads) if len(heads) else values[:0]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


class Bucket:
    """The documents of one bucket in order, with their anchors.

    The bytes of all documents lie in one array, with zeros before, between and after them; ``place``
    counts in it.  Equal neighbouring windows' anchors are one: it is that of the windows ``first`` to ``last``.
    ``listed`` leaves only anchors of these digits and, with ``several``, those whose digit occurs more than once in
    the bucket: all that the passes after the first look at.
    """

    def __init__(self, pdf: pd.DataFrame, listed: np.ndarray | None = None, several: bool = False) -> None:
        order = np.lexsort((pdf["uid"].to_numpy(np.int64), pdf["doc_id"].to_numpy(np.int64), ~pdf["nameless"].to_numpy(bool)))
        self.rows = pdf.iloc[order]
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in self.rows["text"]]
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.ends = np.cumsum(self.sizes + DEPTH)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(bytes(DEPTH).join([b"", *raw, bytes(2 * DEPTH + 8)]), dtype=np.uint8)
        self._words = _words(self.data)
        self._find_anchors()
        if listed is not None:
            wanted = np.isin(self.digit, listed)
            if several:
                by = np.argsort(self.digit)
                same = self.digit[by][1:] == self.digit[by][:-1]
                wanted[by[1:][same]] = True
                wanted[by[:-1][same]] = True
            self._leave(np.flatnonzero(wanted))
        by, new = _grouped(self.context, self.digit)
        heads = np.flatnonzero(new)
        self.of_context = np.empty(len(by), dtype=np.int64)  # the earliest anchor with the same context
        earliest = _least_of(by, heads)
        self.of_context[by] = np.repeat(earliest, np.diff(np.append(heads, len(by))))
        # earliest anchors of each context, ascending, and how many contexts their digits have here
        self.heads = np.sort(earliest)
        _, which, count = np.unique(self.digit[self.heads], return_inverse=True, return_counts=True)
        self.kinds = count[which]

    def _find_anchors(self) -> None:
        total = int(self.ends[-1])
        whole = np.zeros(total, dtype=bool)  # where windows start
        for low, high in zip(self.starts.tolist(), (self.ends - DEPTH + 1).tolist()):
            whole[low : max(low, high)] = True
        found: list[tuple[np.ndarray, ...]] = []
        last = -1
        for start in range(DEPTH, total, _PIECE):
            windows = np.flatnonzero(whole[start : start + _PIECE])
            if not len(windows):
                continue
            n = int(windows[-1]) + 1
            low = start - REACH
            strings = _strings(self._words, low, start + n + 2 * REACH + 1)
            key = strings[REACH : 2 * REACH + n] & _HIGH
            key |= np.arange(len(key), dtype=np.uint64)
            at = (_least(key, REACH + 1) & ~_HIGH).astype(np.int64)[windows]
            new = np.ones(len(at), dtype=bool)
            new[1:] = at[1:] != at[:-1]
            new[0] = at[0] + start != last
            last = int(at[-1]) + start
            at, windows = at[new] + REACH, windows[new]
            found.append((at + low, windows + start, strings[at], *(
                _joined(strings, at, offsets, salt) for offsets, salt in ((_IN_CONTEXT, 2), (_IN_BEFORE, 4), (_IN_AFTER, 5)))))
        kinds = (np.int64, np.int64, *[np.uint64] * 4)
        self.place, self.first, self.digit, self.context, self.before, self.after = (
            np.concatenate(x) if found else np.empty(0, dtype=k) for x, k in zip(zip(*found) if found else kinds, kinds))
        doc = np.searchsorted(self.starts, self.place, "right") - 1
        self.last = np.minimum(np.append(self.first[1:], total) - 1, self.ends[doc] - DEPTH)
        reach = np.minimum(self.place - self.starts[doc], REACH) * 1000 + np.minimum(self.ends[doc] - self.place, DEPTH)
        # bytes behind the reach are zeros of the frame, so equal reaches and bytes have equal hashes
        self.context = mix64(self.context + reach.astype(np.uint64) * _ODD[61])

    def _leave(self, rows: np.ndarray) -> None:
        for name in ("place", "first", "last", "digit", "context", "before", "after"):
            setattr(self, name, getattr(self, name)[rows])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct anchor once: its digit, and its context or 0 where the bucket has several."""
        alone = self.kinds == 1
        first = self.heads[alone]
        many = np.unique(self.digit[self.heads[~alone]])
        return np.append(self.digit[first], many), np.append(self.context[first], np.zeros(len(many), dtype=np.uint64))

    def first_anchors(self, digits: np.ndarray, several: bool) -> np.ndarray:
        """First occurrences (one per context) of anchors listed in ``digits`` or, if asked, of several contexts here."""
        wanted = np.isin(self.digit[self.heads], digits)
        if several:
            wanted |= self.kinds > 1
        return self.heads[wanted]

    def told_contexts(self, told: "Told") -> np.ndarray:
        """Which anchors an earlier bucket has with the same context."""
        return _in_pairs(self.context, self.digit, *told.pairs(CONTEXT))

    def windows(self, places: np.ndarray) -> np.ndarray:
        """Hash of the ``DEPTH`` bytes from each place (ascending)."""
        out = np.empty(len(places), dtype=np.uint64)
        low = 0
        while low < len(places):
            start = int(places[low])
            high = int(np.searchsorted(places, start + _PIECE))
            strings = _strings(self._words, start, int(places[high - 1]) + REACH + 1)
            out[low:high] = _joined(strings, places[low:high] - start, _IN_WINDOW, 3)
            low = high
        return out

    def expand(self, anchors: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, digit, window hash) of the windows of some anchors (ascending), in order.

        ``before`` and ``after`` tell for each anchor which of its halves is looked at.
        """
        place, first, last = self.place[anchors], self.first[anchors], self.last[anchors]
        low = np.where(before, first, np.maximum(first, place - SPLIT))
        high = np.where(after, last, np.minimum(last, place - SPLIT - 1))
        n = np.where(before | after, np.maximum(high - low + 1, 0), 0)
        start = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return start, np.repeat(self.digit[anchors], n), self.windows(start)


def _unsigned(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return pdf[column].to_numpy(np.int64).view(np.uint64)


class Told:
    """What the compared digits, halves, contexts and windows tell a bucket."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        if len(pdf):
            self._kind, self._a, self._b = pdf["kind"].to_numpy(), _unsigned(pdf, "a"), _unsigned(pdf, "b")
        else:
            self._kind, self._a, self._b = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        self.everything = self._a

    def digits(self, kind: int) -> np.ndarray:
        return self._a[self._kind == kind]

    def pairs(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, digit) of one kind."""
        listed = self._kind == kind
        return self._b[listed], self._a[listed]


def bucketed(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str]:
    """Documents in ranges of (doc_id, row), as a bucketed table, and the table's name."""
    spark, row = docs.sparkSession, fresh(docs, "uid")
    n = tables(total_bytes(docs, "text"), bucket_bytes)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.monotonically_increasing_id())
    placed = narrow.repartitionByRange(n, "doc_id", "uid").withColumn("bucket", F.spark_partition_id()).select(
        *whole_id(F.col("doc_id")), "text", "uid", "bucket")
    path = scratch_path(spark, "texts")
    name = "t" + path.rsplit("-", 1)[-1]
    placed.write.bucketBy(n, "bucket").option("path", path).saveAsTable(name)
    return spark.table(name), name


def _sorted_partition(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    held = [pdf for pdf in batches if len(pdf)]
    return pd.concat(held, ignore_index=True) if held else None


def _compare_digits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of several buckets: repeated where all agree (but for the first bucket), else open."""
    pdf = _sorted_partition(batches)
    if pdf is None:
        return
    digit, context, bucket = _unsigned(pdf, "a"), _unsigned(pdf, "b"), pdf["bucket"].to_numpy(np.int64)
    by = np.argsort(digit)
    d, c, b = digit[by], context[by], bucket[by]
    new = np.append(True, d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    size = np.bincount(group)
    differs = np.bincount(group, (c != c[heads][group]) | (c == 0)) > 0
    tell = (size[group] > 1) & (differs[group] | (b != _least_of(b, heads)[group]))
    kind = np.where(differs[group], OPEN, REPEATED)[tell]
    yield pd.DataFrame({"bucket": b[tell].astype(np.int32), "kind": kind.astype(np.int32), "a": _signed(d[tell]), "b": np.zeros(len(kind), dtype=np.int64)})


def _compare_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of several buckets: repeated in all but the first."""
    pdf = _sorted_partition(batches)
    if pdf is None:
        return
    digit, whole, bucket = _unsigned(pdf, "a"), _unsigned(pdf, "b"), pdf["bucket"].to_numpy(np.int64)
    by, new = _grouped(whole, digit)
    b = bucket[by]
    heads = np.flatnonzero(new)
    tell = by[b != np.repeat(_least_of(b, heads), np.diff(np.append(heads, len(by))))]
    yield pd.DataFrame({"bucket": bucket[tell].astype(np.int32), "kind": np.full(len(tell), WINDOW, dtype=np.int32), "a": _signed(digit[tell]), "b": _signed(whole[tell])})


_DIGESTS = "bucket int, a long, b long"
_HALVES = "bucket int, kind int, a long, b long, c long"
_TOLD = "bucket int, kind int, a long, b long"


def _send_digits(pdf: pd.DataFrame) -> pd.DataFrame:
    digit, context = Bucket(pdf).digests()
    return pd.DataFrame({"bucket": np.full(len(digit), pdf["bucket"].iloc[0], dtype=np.int32), "a": _signed(digit), "b": _signed(context)})


def _send_halves(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Each context of the open anchors once, and each half of them once, with its context or 0 where the bucket has several."""
    none = pd.DataFrame({"bucket": np.empty(0, np.int32), "kind": np.empty(0, np.int32), **{c: np.empty(0, np.int64) for c in "abc"}})
    if not len(pdf) or not len(told):
        return none
    bucket = Bucket(pdf, _unsigned(told, "a"))
    anchors = bucket.heads
    own, context = bucket.digit[anchors], bucket.context[anchors]
    digit, half = np.tile(own, 2), np.append(bucket.before[anchors], bucket.after[anchors])
    by, new = _grouped(half, digit)
    heads = np.flatnonzero(new)
    keep = by[heads]
    alone = np.diff(np.append(heads, len(by))) == 1
    which = np.where(alone, np.tile(context, 2)[keep], np.uint64(0))
    kind = np.repeat(np.array([CONTEXT, HALF], dtype=np.int32), [len(own), len(keep)])
    return pd.DataFrame({"bucket": np.full(len(kind), pdf["bucket"].iloc[0], dtype=np.int32), "kind": kind, "a": _signed(np.append(own, digit[keep])),
                         "b": _signed(np.append(context, half[keep])), "c": _signed(np.append(context, which))})


def _compare_halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts that an earlier bucket has, and halves that several buckets have in different contexts."""
    pdf = _sorted_partition(batches)
    if pdf is None:
        return
    digit, hashed, context, bucket, kind = (*(_unsigned(pdf, x) for x in "abc"), pdf["bucket"].to_numpy(np.int64), pdf["kind"].to_numpy())
    by, new = _grouped(hashed, digit)
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    c, b = context[by], bucket[by]
    differs = np.bincount(group, (c != c[heads][group]) | (c == 0)) > 0
    size = np.bincount(group)
    whole = kind[by] == CONTEXT
    tell = by[(size[group] > 1) & np.where(whole, b != _least_of(b, heads)[group], differs[group])]
    yield pd.DataFrame({"bucket": bucket[tell].astype(np.int32), "kind": kind[tell].astype(np.int32), "a": _signed(digit[tell]), "b": _signed(hashed[tell])})


def _open_halves(bucket: Bucket, told: Told, several: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, before, after): first anchors that are open, and which halves occur again.

    Anchors whose context an earlier bucket has are settled by it.  Halves told from other buckets count, and with
    ``several`` those that occur twice in this one.
    """
    anchors = bucket.first_anchors(told.digits(OPEN), several)
    anchors = anchors[~bucket.told_contexts(told)[anchors]]
    digit, half = np.tile(bucket.digit[anchors], 2), np.append(bucket.before[anchors], bucket.after[anchors])
    again = _in_pairs(half, digit, *told.pairs(HALF))
    if several and len(half):
        by, new = _grouped(half, digit)
        group = np.cumsum(new) - 1
        again[by] |= np.bincount(group)[group] > 1
    return anchors, again[: len(anchors)], again[len(anchors) :]


def _send_windows(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"bucket": np.empty(0, np.int32), "a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if not len(pdf) or not len(told):
        return none
    known = Told(told)
    bucket = Bucket(pdf, known.digits(OPEN))
    _, digit, whole = bucket.expand(*_open_halves(bucket, known, several=False))
    by, new = _grouped(whole, digit)
    keep = by[new]
    return pd.DataFrame({"bucket": np.full(len(keep), pdf["bucket"].iloc[0], dtype=np.int32), "a": _signed(digit[keep]), "b": _signed(whole[keep])})


def removed_bytes(bucket: Bucket, told: Told) -> np.ndarray:
    """Which bytes of a bucket a window covers that repeats an earlier one."""
    # anchors whose whole context came before: later ones here, and all where an earlier bucket has it
    again = bucket.of_context != np.arange(len(bucket.place))
    again |= np.isin(bucket.digit, told.digits(REPEATED)) | bucket.told_contexts(told)
    edge = np.zeros(len(bucket.data) + 1, dtype=np.int32)
    edge[bucket.first[again]] += 1  # neighbouring anchors' windows do not overlap, so no place is named twice
    edge[bucket.last[again] + DEPTH] -= 1
    start, digit, whole = bucket.expand(*_open_halves(bucket, told, several=True))
    if len(start):
        by, new = _grouped(whole, digit)
        heads = np.flatnonzero(new)
        gone = np.ones(len(start), dtype=bool)
        gone[_least_of(by, heads)] = False  # windows come in document order
        gone |= _in_pairs(whole, digit, *told.pairs(WINDOW))
        edge[start[gone]] += 1
        edge[start[gone] + DEPTH] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _in_pairs(w: np.ndarray, d: np.ndarray, listed_w: np.ndarray, listed_d: np.ndarray) -> np.ndarray:
    """Which (w, d) are among the listed pairs."""
    if not len(w) or not len(listed_w):
        return np.zeros(len(w), dtype=bool)
    by, new = _grouped(np.concatenate([listed_w, w]), np.concatenate([listed_d, d]))
    heads = np.flatnonzero(new)
    listed = _least_of(by, heads) < len(listed_w)
    out = np.empty(len(by), dtype=bool)
    out[by] = np.repeat(listed, np.diff(np.append(heads, len(by))))
    return out[len(listed_w) :]


def _settle(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame({"doc_id": [], "nameless": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []})
    known = Told(told)
    bucket = Bucket(pdf, known.everything, several=True)
    covered = removed_bytes(bucket, known)
    rows = []
    for low, high in zip(bucket.starts.tolist(), bucket.ends.tolist()):
        raw, gone = bucket.data[low:high], covered[low:high]
        removed = int(np.count_nonzero(gone))
        if not removed:
            rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
            continue
        spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        rows.append((len(raw), removed, spans, hashlib.sha256(raw[~gone]).hexdigest()))
    out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    out.insert(0, "doc_id", bucket.rows["doc_id"].to_numpy())
    out.insert(1, "nameless", bucket.rows["nameless"].to_numpy())
    return out


def dedup_substrings(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    A byte goes when a ``DEPTH``-byte string over it also starts earlier: in a document of
    smaller doc_id (null first; rows that repeat a doc_id in table order), or earlier in the
    same one.  Null and empty texts have no bytes.  Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    with clean_shuffles(spark):
        texts, name = bucketed(docs, bucket_bytes)
        width = max(parts(spark), tables(total_bytes(docs, "text"), bucket_bytes))
        by_bucket = texts.groupBy("bucket")
        digits = by_bucket.applyInPandas(_send_digits, _DIGESTS).repartition(width, "a")
        told = materialize(digits.mapInPandas(_compare_digits, _TOLD), "digits")
        open_anchors = told.filter(F.col("kind") == OPEN)
        halves = by_bucket.cogroup(open_anchors.groupBy("bucket")).applyInPandas(_send_halves, _HALVES).repartition(width, "b")
        again = materialize(halves.mapInPandas(_compare_halves, _TOLD), "halves")
        asked = open_anchors.unionByName(again)
        windows = by_bucket.cogroup(asked.groupBy("bucket")).applyInPandas(_send_windows, _DIGESTS).repartition(width, "b")
        repeated = materialize(windows.mapInPandas(_compare_windows, _TOLD), "windows")
        everything = told.unionByName(again).unionByName(repeated)
        done = by_bucket.cogroup(everything.groupBy("bucket")).applyInPandas(
            _settle, "doc_id long, nameless boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        result = materialize(done.withColumn("doc_id", named_id()).drop("nameless"), "settled")
        _drop(spark, name, texts)
        return result


def _drop(spark: SparkSession, name: str, texts: DataFrame) -> None:
    forget(texts)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
