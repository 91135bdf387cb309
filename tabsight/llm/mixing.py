"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k being the inverse of the Poisson distribution with its
source's mean repetition rate at a number drawn from the hash of its key.  The rate is the
target share of the source times the wanted size, over the size it has.  Copies are then
shuffled globally by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import fresh, materialize, text_bytes
from tabsight.operators.ordered import number_rows

SEED = 17
TEMPERATURE = 0.7  # a source of n bytes weighs n ** 0.7: small sources are repeated, large ones thinned
DRAW_RATE = 256.0  # largest mean of one draw; a higher rate is the sum of several draws


def drawn(key: Column, salt: str | Column) -> Column:
    """A number in (0, 1) from 52 bits of md5(salt:key)."""
    digest = F.md5(F.concat(F.lit(salt) if isinstance(salt, str) else salt, F.lit(":"), key).cast("binary"))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return (number + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, … as far as doubles tell it from 1 (mean plus twelve deviations and 40 more)."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k.cast("double")
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["steps"], F.array(c)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["steps"])


def source_rates(
    docs: DataFrame, source: str, text: str, weights: Mapping[str, float] | None = None, size: float | None = None,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """(source, bytes, share, rate): one row per source, null being a source of its own.

    With ``weights``, a source's share is its weight over the sum, and unlisted sources get
    nothing; else its bytes to the power of ``temperature``.  ``size`` is the wanted number of
    bytes, by default what there is.  A source without any bytes has rate 1.
    """
    label = F.col(f"`{source}`").cast("string")
    sizes = docs.select(label.alias("source"), text_bytes(F.col(f"`{text}`")).alias("b")).groupBy("source").agg(
        F.sum("b").cast("double").alias("bytes")
    )
    if weights is None:
        weight = F.when(F.col("bytes") > 0, F.pow("bytes", F.lit(float(temperature)))).otherwise(F.lit(0.0))
    else:
        listed = {k: float(v) for k, v in weights.items()}
        table = F.create_map(*[F.lit(x) for kv in listed.items() for x in kv]) if listed else None
        weight = F.lit(0.0) if table is None else F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), F.lit(0.0))
    # the sums are one row; joining them keeps the plan free of windows without a key
    weighed = sizes.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes")).first()
    all_weight, all_bytes = float(sums["all_weight"] or 0.0), float(sums["all_bytes"] or 0.0)
    wanted = all_bytes if size is None else float(size)
    share = F.col("weight") / F.lit(all_weight) if all_weight > 0 else F.lit(0.0)
    rate = F.when(F.col("bytes") > 0, share * F.lit(wanted) / F.col("bytes")).otherwise(F.lit(1.0))
    return weighed.select("source", "bytes", share.alias("share"), rate.alias("rate"))


def replicate(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: Mapping[str, float] | None = None, size: float | None = None, seed: int = SEED,
    copy: str = "copy", rate: str = "rate", order: str = "shuffle_key",
) -> DataFrame:
    """Every column of ``docs``, repeated by the Poisson count, with copy number, rate and shuffle key.

    The count depends on key, seed and the source's rate alone, so any executor draws it
    alike.  Rows that repeat a key get equal counts; a null key counts as the empty one; a
    null source is a source of its own; null and empty texts have no bytes but are drawn like
    the rest of their source.  Existing columns of the added names are replaced.

    The rate table has a row per source; adaptive execution broadcasts it while it is small
    and else splits a hot source.  Copies are made by exploding after that join.
    """
    rates = materialize(source_rates(docs, source, text, weights, size), "rates")
    name, label = fresh(docs, "_key"), fresh(docs, "_source")
    draws = F.greatest(F.ceil(F.col("rate") / DRAW_RATE), F.lit(1))
    steps = rates.select(F.struct(F.lit(1).alias("k"), "source").alias(label), F.col("rate").alias(fresh(docs, "_rate")),
                         draws.alias(fresh(docs, "_draws")), poisson_steps(F.col("rate") / draws).alias(fresh(docs, "_steps")))
    base = docs.drop(copy, rate, order)
    keyed = base.withColumns({
        name: F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")),
        label: F.struct(F.lit(1).alias("k"), F.col(f"`{source}`").cast("string").alias("source")),
    })
    met = keyed.join(steps, keyed[label].eqNullSafe(steps[label])).drop(steps[label])
    below = lambda u: F.size(F.filter(fresh_col(docs, "_steps"), lambda c: c < u))
    # sums of Poisson numbers are Poisson numbers of the summed mean
    more = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), fresh_col(docs, "_draws") - 1), F.lit(0),
        lambda n, i: n + below(drawn(F.col(name), F.concat(F.lit(f"count{seed}."), i.cast("string")))))
    count = below(drawn(F.col(name), f"count{seed}")) + F.when(fresh_col(docs, "_draws") > 1, more).otherwise(F.lit(0))
    made = met.withColumn(copy, F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    shuffled = F.md5(F.concat(F.lit(f"order{seed}:"), F.col(name), F.lit(":"), F.col(copy).cast("string")).cast("binary"))
    return made.withColumns({rate: fresh_col(docs, "_rate"), order: shuffled}).drop(
        name, label, fresh(docs, "_rate"), fresh(docs, "_draws"), fresh(docs, "_steps")
    )


def fresh_col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{fresh(df, name)}`")


def shuffle_globally(copies: DataFrame, order: str = "shuffle_key") -> DataFrame:
    """Rows in the order of a hash: ranges of the hash make partitions, sorted within."""
    row = fresh(copies, "_row")
    return copies.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(
        F.col(order), F.col(row)).sortWithinPartitions(order, row).drop(row)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, in global shuffle order."""
    added = {n: fresh(docs, n) for n in ("copy", "rate", "shuffle_key")}
    copies = replicate(docs, weights=weights, seed=seed, copy=added["copy"], rate=added["rate"], order=added["shuffle_key"])
    return shuffle_globally(copies, added["shuffle_key"]).select(*[f"`{c}`" for c in docs.columns])


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy, rate, position): the mixed corpus as references, in shuffled order.

    ``position`` is the place of the copy in the global shuffle, gapless from 0; the texts stay
    where they are.
    """
    narrow = docs.select("doc_id", "source", "text")
    copies = replicate(narrow, weights=weights, seed=seed).drop("text").withColumn("_row", F.monotonically_increasing_id())
    placed = number_rows(copies, ["shuffle_key", "doc_id", "_row"])
    return placed.frame.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("copy").cast("int").alias("copy"), F.round("rate", 9).alias("rate"), F.col("_g").cast("long").alias("position"),
    )


# one draw for each document: holds while no rate exceeds DRAW_RATE
_TOP = math.ceil(DRAW_RATE + 12 * math.sqrt(DRAW_RATE) + 40)
MIX_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS b FROM documents GROUP BY source),
weighed AS (SELECT source, b, CASE WHEN b > 0 THEN pow(b, {TEMPERATURE}) ELSE 0 END AS w FROM sizes),
rates AS (SELECT source, CASE WHEN b > 0 THEN w / (SELECT sum(w) FROM weighed) * (SELECT sum(b) FROM weighed) / b
                              ELSE 1.0 END AS rate FROM weighed),
terms AS (SELECT source, rate, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) ELSE CAST(k = 0 AS INT) END AS p
          FROM rates CROSS JOIN (SELECT unnest(range(0, {_TOP} + 1)) AS k) ks WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
steps AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, source, (CAST('0x' || substr(md5('count{SEED}:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
          FROM documents),
counts AS (SELECT d.doc_id, d.source, s.rate, count(*) FILTER (WHERE s.c < d.u) AS n
           FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
copies AS (SELECT doc_id, source, rate, CAST(unnest(range(0, n)) AS INT) AS copy FROM counts)
SELECT doc_id, source, copy, round(rate, 9) AS rate,
       row_number() OVER (ORDER BY md5('order{SEED}:' || doc_id || ':' || copy), doc_id) - 1 AS position
FROM copies"""
