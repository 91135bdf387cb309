"""Primary and foreign keys of a data dictionary, enforced.

Rows become distinct keys with counts before anything is joined: partial counts in the scan turn
a hot key into one row per task, so neither side of the anti join holds a key twice and no
key is skewed.  When the referring side has few keys, a Bloom filter of them stops the other rows of
the referenced table before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import present
from tabsight.sources.dictionary import Keys
from tabsight.sources.scratch import materialize

BLOOM_BITS = 1 << 23
BLOOM_KEYS = 1 << 20  # 8 bits a key: about 2 % pass by chance
BLOOM_HASHES = 5
_ISSUE = "severity string, rule string, column string, n bigint"


def _parts(df: DataFrame, columns: Sequence[str], like: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The key columns under neutral names, in the types of ``like``'s parts where given."""
    names = [f"_k{i}" for i in range(len(columns))]
    cells: list[Column] = [present(df, c) for c in columns]
    if like is not None:
        cells = [c.try_cast(like.schema[n].dataType) for c, n in zip(cells, names)]
    return df.select(*[c.alias(n) for c, n in zip(cells, names)]), names


def _complete(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def _named(frame: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return frame.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "n")


def pk_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key columns…, n): keys that n > 1 rows have.  Keys with a missing part are no keys (see ``pk_nulls``)."""
    rows, names = _parts(df, columns)
    counted = rows.filter(_complete(names)).groupBy(*names).agg(F.count("*").alias("n"))
    return _named(counted.filter("n > 1"), names, columns)


def pk_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n): rows in whose key some part is missing."""
    rows, names = _parts(df, columns)
    return rows.agg(F.count_if(~_complete(names)).alias("n"))


def _places(hashes: np.ndarray) -> np.ndarray:
    """Bit positions of each key, by double hashing of the halves of its hash."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def bloom_filter(keys: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Bits of a Bloom filter of the keys; one array of fixed size per task, at most eight, reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, dtype=bool)
        for batch in batches:
            bits[_places(batch.column(0).to_numpy()).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    rows = keys.select(F.xxhash64(*names).alias("h")).coalesce(8).mapInArrow(run, "bits binary").collect()
    out = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for r in rows:
        out |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def _passing(rows: DataFrame, names: Sequence[str], bits: np.ndarray) -> DataFrame:
    """The rows whose key may be in the filter."""
    packed = bits.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        for batch in batches:
            keep = table[_places(batch.column(batch.num_columns - 1).to_numpy())].all(axis=1)
            yield batch.filter(pa.array(keep)).select(list(range(batch.num_columns - 1)))

    return rows.select(*names, F.xxhash64(*names).alias("_h")).mapInArrow(run, rows.select(*names).schema)


def fk_orphans(child: DataFrame, columns: Sequence[str], parent: DataFrame, references: Sequence[str]) -> DataFrame:
    """(key columns…, n): keys of n rows of ``child`` that no row of ``parent`` has.

    Keys with a missing part refer to nothing and are no orphans.  Parts are compared in the types of ``child``.
    """
    rows, names = _parts(child, columns)
    keys = materialize(rows.filter(_complete(names)).groupBy(*names).agg(F.count("*").alias("n")), "keys")
    held, _ = _parts(parent, references, keys)
    held = held.filter(_complete(names))
    if keys.count() <= BLOOM_KEYS:
        held = _passing(held, names, bloom_filter(keys, names))
    return _named(keys.join(held.distinct(), names, "left_anti"), names, columns)


def check_keys(df: DataFrame, keys: Keys, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Issues of the keys, as rows like those of ``validate``; n counts rows.

    ``primary_key``: rows that share their key, ``primary_key_null``: rows without a whole key, ``foreign_key``:
    rows that refer to nothing.  A key with a column the table lacks is an error, a referenced table that is not
    in ``tables`` a warning.
    """
    tables = tables or {}
    out = df.sparkSession.createDataFrame([], _ISSUE)

    def add(frame: DataFrame, severity: str, rule: str, columns: Sequence[str]) -> None:
        nonlocal out
        found = frame.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).filter("n > 0")
        out = out.unionByName(found.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(", ".join(columns)).alias("column"), "n"))

    one = df.sparkSession.range(1).select(F.lit(1).alias("n"))
    if keys.primary:
        if set(keys.primary) <= set(df.columns):
            add(pk_duplicates(df, keys.primary), "error", "primary_key", keys.primary)
            add(pk_nulls(df, keys.primary), "error", "primary_key_null", keys.primary)
        else:
            add(one, "error", "key_column_missing", keys.primary)
    for k in keys.foreign:
        if k.table not in tables:
            add(one, "warning", "referenced_table_missing", k.columns)
        elif not set(k.columns) <= set(df.columns) or not set(k.references) <= set(tables[k.table].columns):
            add(one, "error", "key_column_missing", k.columns)
        else:
            add(fk_orphans(df, k.columns, tables[k.table], k.references), "error", "foreign_key", k.columns)
    return out
