"""Records of delimited text whose quoted fields hold line breaks, read by many tasks.

Whether a line starts inside a quoted field depends on everything before it, so one file is
usually one task.  Here every line is a function of two states (it starts outside or inside a
quoted field; where does it end?).  Functions compose, so

1. each input split composes its lines (one small row per split),
2. a prefix over the splits of a file gives the state in which each of them starts,
3. each split cuts its lines at true record ends; the pieces of records that cross a split's
   edge, at most two for a split, are shuffled and put together.

A quote opens a field only where the field starts, a doubled quote inside a quoted field is a
quote, and what follows a closing quote up to the delimiter belongs to the field, as the reader of
whole files has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabsight.sources.scratch import materialize

LINE_FEED = b"\n"
_SPLIT = "file string, block long, end_outside boolean, end_inside boolean, starts_inside boolean, crlf boolean"
_PIECES = "file string, block long, head long, first boolean, crlf boolean, record binary"
TRIES = 3


def _patterns(delimiter: str) -> tuple[str, str]:
    """Regular expressions for lines that end inside a quoted field, when they start outside and inside one.

    All repetitions are possessive: no backtracking, and no recursion on long lines.
    """
    d = re.escape(delimiter)
    quoted = '[^"]*+(?:""[^"]*+)*+'
    fields = f'(?:(?:"{quoted}"[^{d}]*+|[^"{d}][^{d}]*+|){d})*+'
    outside = f'(?s)^{fields}"{quoted}$'
    inside = f'(?s)^{quoted}(?:"[^{d}]*+{d}{fields}"{quoted})?+$'
    return outside, inside


def _functions(delimiter: str, line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field: when it starts outside, when it starts inside one."""
    outside, inside = _patterns(delimiter)
    quoted = F.contains(line, F.lit('"'))
    return quoted & line.rlike(outside), ~quoted | line.rlike(inside)


def after_lines(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """The state after each line (True: inside a quoted field), given the state before the first.

    A line that ends the same either way settles the state; lines between two such ones keep or turn it.
    """
    n = len(outside)
    settled = np.maximum.accumulate(np.where(outside == inside, np.arange(n), -1))
    turned = np.cumsum(outside & ~inside)
    base = np.where(settled >= 0, outside[settled] ^ (turned[settled] % 2 == 1), start)
    return base ^ (turned % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, block, rows) for each stretch of a batch that comes from one split."""
    if not batch.num_rows:
        return
    files = batch.column(0).dictionary_encode()
    names, codes = files.dictionary.to_pylist(), files.indices.to_numpy()
    blocks = batch.column(1).to_numpy()
    edges = [0, *((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])).nonzero()[0] + 1, batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield names[codes[a]], int(blocks[a]), batch.slice(a, b - a)


def _flags(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(bool)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: its lines as one function, and whether a record starts in it when it starts inside one."""
    at, ends, starts, crlf = None, [False, True], False, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"file": at[0], "block": at[1], "end_outside": ends[0], "end_inside": ends[1], "starts_inside": starts, "crlf": crlf}],
            schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("end_outside", pa.bool_()),
                              ("end_inside", pa.bool_()), ("starts_inside", pa.bool_()), ("crlf", pa.bool_())]))

    for batch in batches:
        for file, block, some in _runs(batch):
            if (file, block) != at:
                if at is not None:
                    yield row()
                at, ends, starts, crlf = (file, block), [False, True], False, bool(some.column(4)[0].as_py())
            outside, inside = _flags(some, 2), _flags(some, 3)
            starts = starts or not ends[1]
            reached = [after_lines(outside, inside, s) for s in ends]
            starts = starts or not reached[1][:-1].all()
            ends = [bool(r[-1]) for r in reached]
    if at is not None:
        yield row()


def _lines(spark: SparkSession, paths: Sequence[str], delimiter: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    outside, inside = _functions(delimiter, F.col("value"))
    return lines.select("file", "block", outside.alias("outside"), inside.alias("inside"), F.endswith("value", F.lit("\r")).alias("cr"), "value")


def split_states(spark: SparkSession, paths: Sequence[str], delimiter: str = ",") -> DataFrame:
    """(file, block, state, head, crlf) of each split.

    ``state``: whether it starts inside a quoted field; ``head``: the split in which its open record started;
    ``crlf``: whether the first line of the file ends with a carriage return.
    """
    found = _lines(spark, paths, delimiter).select("file", "block", "outside", "inside", "cr").mapInArrow(_compose, _SPLIT)
    found = materialize(found, "splits")  # one row per split
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    settles = F.col("end_outside") == F.col("end_inside")
    turns = F.sum((F.col("end_outside") & ~F.col("end_inside")).cast("int")).over(before)
    found = found.withColumn("turns", turns)
    last = F.last(F.when(settles, F.struct("end_outside", "turns")), ignorenulls=True).over(before)
    odd = (F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    found = found.withColumn("last", last).withColumn("ends", F.coalesce(F.col("last.end_outside"), F.lit(False)) != odd)
    order = W.partitionBy("file").orderBy("block")
    found = found.withColumn("inside", F.coalesce(F.lag("ends").over(order), F.lit(False)))
    opens = F.col("ends") & (~F.col("inside") | F.col("starts_inside"))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    head = F.last(F.when(opens, F.col("block")), ignorenulls=True).over(earlier)
    return found.select(
        "file", "block", F.col("inside").alias("state"), F.when(F.col("inside"), head).alias("head"),
        F.first("crlf").over(before).alias("crlf"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (head null), and the pieces of records that start before a split or go on after it."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("head", pa.int64()), ("first", pa.bool_()),
                        ("crlf", pa.bool_()), ("record", pa.binary())])
    at, state, head, first, lead, crlf = None, False, None, False, False, False
    pending: list[bytes] = []

    def rows(records: pa.Array, heads: list) -> pa.RecordBatch:
        nonlocal first
        n = len(records)
        flags = np.zeros(n, dtype=bool)
        flags[:1] = first
        first = first and not n
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * n, pa.string()), pa.array(np.full(n, at[1])), pa.array(heads, pa.int64()), pa.array(flags),
             pa.array(np.full(n, crlf)), records], schema=schema)

    def close(complete: bool) -> pa.RecordBatch:
        """The pending record ends here, or goes on in the next split."""
        joined = pa.array([LINE_FEED.join(pending)], pa.binary())
        pending.clear()
        return rows(joined, [head if lead else None if complete else at[1]])

    for batch in batches:
        for file, block, some in _runs(batch):
            if (file, block) != at:
                if pending:
                    yield close(not state)
                at, first = (file, block), block == 0
                state, head, crlf = (some.column(c)[0].as_py() for c in (5, 6, 7))
                lead = state
            reached = after_lines(_flags(some, 2), _flags(some, 3), state)
            starts = np.concatenate([[state], reached[:-1]]) == 0
            places = starts.nonzero()[0]
            values = some.column(4)
            if not len(places):  # all of it goes on with the pending record
                pending += values.to_pylist()
            else:
                pending += values.slice(0, places[0]).to_pylist()
                if pending:
                    yield close(True)
                lead = False
                if len(places) > 1:
                    offsets = pa.array(places - places[0], pa.int32())
                    body = values.slice(places[0], places[-1] - places[0])
                    records = pc.binary_join(pa.ListArray.from_arrays(offsets, body), pa.scalar(LINE_FEED, pa.binary()))
                    yield rows(records, [None] * len(records))
                pending += values.slice(places[-1]).to_pylist()
            state = bool(reached[-1])
    if pending:
        yield close(not state)


def split_records(spark: SparkSession, paths: Sequence[str], delimiter: str = ",") -> DataFrame:
    """(file, first, crlf, record): every record of the files as raw bytes; ``first`` marks a file's first one.

    The records are written once.  The two passes must see the same splits; should the cluster's size have
    changed them in between, the passes are repeated.
    """
    for _ in range(TRIES):
        states = materialize(split_states(spark, paths, delimiter), "states")
        lines = _lines(spark, paths, delimiter).withColumn("value", F.col("value").cast("binary"))
        placed = lines.join(F.broadcast(states), ["file", "block"], "left")  # one row per split
        placed = placed.select("file", "block", "outside", "inside", "value", F.coalesce("state", F.lit(False)).alias("state"), "head",
            F.coalesce("crlf", F.lit(False)).alias("crlf"))
        cut = materialize(placed.mapInArrow(_cut, _PIECES), "records")
        seen = cut.select("file", "block").distinct()
        known = states.select("file", "block")
        if not seen.join(known, ["file", "block"], "left_anti").limit(1).count() and not known.join(seen, ["file", "block"], "left_anti").limit(1).count():
            break
    else:
        raise RuntimeError("the input splits changed between the passes")
    whole = cut.filter(F.col("head").isNull()).select("file", "first", "crlf", "record")
    pieces = cut.filter(F.col("head").isNotNull()).groupBy("file", "head").agg(
        F.max("first").alias("first"), F.max("crlf").alias("crlf"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    glued = F.aggregate(
        F.expr("slice(parts, 2, size(parts))"), F.col("parts")[0]["record"], lambda a, p: F.concat(a, F.lit(bytearray(LINE_FEED)), p["record"]))
    return whole.unionByName(pieces.select("file", "first", "crlf", glued.alias("record")))


def record_text(encoding: str = "UTF-8") -> Column:
    """``record`` as text; in files whose lines end with CR LF, without the last CR and with line feeds alone inside."""
    text = F.col("record").cast("string") if encoding.upper() == "UTF-8" else F.decode("record", encoding)
    return F.when(F.col("crlf"), F.replace(F.regexp_replace(text, r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(text)


def splittable(delimiter: str, encoding: str) -> bool:
    """Delimiters of one ASCII sign and encodings in which line feeds and quotes are single bytes."""
    return len(delimiter) == 1 and delimiter.isascii() and encoding.upper() in ("UTF-8", "ISO-8859-1", "US-ASCII", "WINDOWS-1252")


def scan_quoted(spark: SparkSession, paths: Sequence[str], delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Text columns of header CSV files with quoted line breaks; the header is that of the first file.

    Equal to the reader that takes a file as a whole, for lines that end with a line feed, with or without a carriage return
    before it.
    """
    options = {"sep": delimiter, "escape": '"', "multiLine": "true"}
    names = spark.read.csv(list(paths), header=True, encoding=encoding, inferSchema=False, **options).schema
    records = split_records(spark, paths, delimiter).filter(~F.col("first")).select(record_text(encoding).alias("text"))
    records = records.filter(F.col("text") != "")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in names.fields)
    return records.select(F.from_csv("text", ddl, options).alias("row")).select("row.*")
