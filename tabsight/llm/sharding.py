"""Weighted rendezvous sharding of records by a stable key.

Every (key, shard) pair gets a hash-drawn score; the record goes to the shard with the best
one.  A new shard can only win records for itself, so no record moves between old shards,
and a shard's expected share is its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import text_bytes
from tabsight.operators.ordered import rank_within

SHARDS = 40
RECORD_OVERHEAD = 16  # bytes a record costs besides its text


def score(key: Column, shard: Column | int, weight: float) -> Column:
    """The cost -ln(u)/weight of a key in a shard, u drawn from 52 bits of md5(key#shard)."""
    number = shard if isinstance(shard, Column) else F.lit(shard)
    digest = F.md5(F.concat_ws("#", key, number.cast("string")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.ln((drawn.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of least cost, the lower number on a tie; shards of weight 0 get nothing."""
    chosen = [F.struct(score(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not chosen:
        raise ValueError("no shard has a positive weight")
    return (F.least(*chosen) if len(chosen) > 1 else chosen[0]).getField("shard")


def assign_shards(
    records: DataFrame, key: str, weights: Sequence[float] | int = SHARDS, grown_weight: float = 1.0,
    shard: str = "shard", grown: str | None = None,
) -> DataFrame:
    """Add the shard of each record and, if ``grown`` names a column, its shard after one more is added.

    A projection: no shuffle.  The key is compared as text; a null key counts as the empty
    one, equal keys share a shard.  A column of the same name is replaced.
    """
    share = [1.0] * weights if isinstance(weights, int) else list(weights)
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    added = {shard: rendezvous(name, share)}
    if grown is not None:
        more = score(name, len(share), grown_weight)
        best = F.least(*[score(name, i, w) for i, w in enumerate(share) if w > 0], F.lit(float("inf")))
        added[grown] = F.when(more < best, F.lit(len(share))).otherwise(added[shard])
    return records.withColumns(added)


def with_slots(records: DataFrame, shard: str, order_by: Sequence[str], slot: str = "slot") -> DataFrame:
    """Add each record's place in its shard, gapless from 0 in the order given; a column of that name is replaced.

    Rows are range-partitioned by (shard, order, row id) and written once in that order, so
    neither a large shard nor a repeated key fills one task, and a lost executor costs a
    re-read.  Rows equal in the whole order are numbered in any order among themselves.
    """
    kept = [c for c in records.columns if c.lower() != slot.lower()]
    whole = records.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("record"), F.col(f"`{shard}`").alias("shard"))
    whole = whole.withColumn("row", F.monotonically_increasing_id())
    ranked = rank_within(whole, ["shard"], [*[F.col(f"record.`{c}`") for c in order_by], "row"])
    return ranked.select("record.*", (F.col("rank") - 1).alias(slot))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every column of ``docs`` with ``shard`` and ``slot``, by the rendezvous law of ``doc_id``."""
    return with_slots(assign_shards(docs, "doc_id", shards), "shard", ["doc_id"])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    Null text: size 16 and the checksum of nothing (0).  Null doc_id: the empty key, sorted
    first.  Repeated rows share a shard and get slots of their own.  An empty table gives no
    rows; other columns are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (text_bytes(F.col("text")) + RECORD_OVERHEAD).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    placed = assign_shards(narrow, "doc_id", shards, grown="grown_shard")
    return with_slots(placed, "shard", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


SHARD_SQL = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + {RECORD_OVERHEAD} AS size, coalesce(text, '') AS body FROM documents),
drawn AS (SELECT doc_id, size, body, s.shard,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || s.shard), 1, 13) AS BIGINT) AS draw
          FROM d CROSS JOIN (SELECT unest AS shard FROM (SELECT unnest(range(0, {SHARDS} + 1)) AS unest)) s),
best AS (SELECT doc_id, any_value(size) AS size, any_value(body) AS body,
                arg_max(shard, draw) FILTER (WHERE shard < {SHARDS}) AS shard, arg_max(shard, draw) AS grown
         FROM drawn GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM best"""
