"""Logs in time: sessions, sliding windows and as-of joins, without a task that holds a whole key.

Sessions and as-of joins run on blocks of the global row order (see ``ordered``): inside a block
an ordinary window, and from block to block one carried row, so a key may hold any share of the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabsight.functions.columns import micros_between
from tabsight.operators.ordered import BLOCK, ORDINAL, block_window, blocks, number_rows
from tabsight.sources.scratch import materialize

SECOND = 1_000_000


def _carry(per_block: DataFrame, value: str, name: str) -> DataFrame:
    """(block, ``name``): the last ``value`` of an earlier block; the window sees one row per block."""
    earlier = W.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    return per_block.select(BLOCK, F.last(value, ignorenulls=True).over(earlier).alias(name))


def sessions(
    log: DataFrame, entity: Sequence[str], ts: str, ids: Sequence[str], gap_seconds: float, block_size: int | None = None
) -> DataFrame:
    """(entity…, session_start, session_end, entries): runs of entries no more than the gap apart.

    An entry later than ``gap_seconds`` after the one before opens a session; a gap of exactly that
    length does not.  ``session_end`` is the time of the last entry.  Entries without a time are in no
    session, those without an entity are an entity of their own, repeated rows count as often as they
    come, and an empty log has no sessions.
    """
    entity = list(entity)
    timed = log.filter(F.col(ts).isNotNull()).select(*entity, ts, *ids)
    placed = blocks(number_rows(timed, [*entity, ts, *ids]), before=1, size=block_size)
    w = block_window(entity)
    since = micros_between(F.lag(ts).over(w), F.col(ts))
    own = placed.withColumn("_opens", since.isNull() | (since > int(gap_seconds * SECOND))).filter(~F.col("_halo"))
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("_session", F.max(F.when(F.col("_opens"), F.col(ORDINAL))).over(so_far))
    pieces = materialize(
        own.groupBy(BLOCK, *entity, "_session").agg(
            F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count("*").alias("_n")
        ),
        "sessions",
    )
    # a piece without an opening entry goes on with the session that was open at its block's edge
    opened = _carry(pieces.groupBy(BLOCK).agg(F.max("_session").alias("_last")), "_last", "_carried")
    whole = pieces.join(opened, BLOCK).withColumn("_session", F.coalesce("_session", "_carried"))
    merged = whole.groupBy(*entity, "_session").agg(
        F.min("_from").alias("session_start"), F.max("_to").alias("session_end"), F.sum("_n").alias("entries")
    )
    return merged.drop("_session")


def sliding(log: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """(keys…, window_start, window_end, aggregates…) of overlapping windows; also on streams with a watermark on ``ts``.

    Windows hold their start and not their end, and begin at multiples of ``slide``.  Entries without a time
    are in no window; a window without entries has no row.
    """
    grouped = log.groupBy(F.window(ts, size, slide).alias("_w"), *keys).agg(*aggregates)
    bounds = [F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")]
    return grouped.select(*keys, *bounds, *[c for c in grouped.columns if c not in ("_w", *keys)])


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    right_ids: Sequence[str],
    right_ts: str | None = None,
    within_seconds: float | None = None,
    block_size: int | None = None,
) -> DataFrame:
    """Every left row with ``values`` of the right row of its key that is the latest not after it, and its time ``matched_at``.

    Rows of both sides are put in one order by (keys, time, right before left), so one pass over blocks
    replaces the range join.  Among right rows of the same time the greatest ``right_ids`` counts.  With
    ``within_seconds`` an older match is none (an interval join with its latest partner).  Left rows without
    a match, a key or a time keep nulls; right rows without a key or a time match nothing.
    """
    keys, values = list(keys), list(values)
    clash = sorted({*values, "matched_at"} & set(left.columns))
    if clash:
        raise ValueError(f"left columns carry names of the result: {clash}")
    at = right_ts or ts
    found = F.struct(F.col(at).alias("matched_at"), *values)
    usable = right.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, at)]))
    offers = usable.select(*keys, F.col(at).alias(ts), F.lit(0).alias("_side"), F.struct(*right_ids).alias("_tie"), found.alias("_right"))
    asks = left.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    rows = number_rows(asks.unionByName(offers, allowMissingColumns=True), [*keys, ts, "_side", "_tie"])
    placed = blocks(rows, size=block_size)
    offer = F.col("_side") == 0
    latest = F.max_by(F.struct(F.struct(*keys).alias("key"), "_right"), F.when(offer, F.col(ORDINAL)))
    carried = _carry(placed.groupBy(BLOCK).agg(latest.alias("_latest")), "_latest", "_carried")
    so_far = block_window(keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = placed.withColumn("_seen", F.last(F.when(offer, F.col("_right")), ignorenulls=True).over(so_far)).filter(~offer)
    joined = seen.select(BLOCK, *keys, ts, "_left", "_seen").join(carried, BLOCK)
    same = F.col("_carried.key").eqNullSafe(F.struct(*keys))
    match = F.coalesce("_seen", F.when(same, F.col("_carried._right")))
    if within_seconds is not None:
        near = micros_between(F.col("_match.matched_at"), F.col(ts)) <= int(within_seconds * SECOND)
        joined = joined.withColumn("_match", match).withColumn("_match", F.when(near, F.col("_match")))
    else:
        joined = joined.withColumn("_match", match)
    return joined.select("_left.*", *[F.col(f"_match.`{c}`").alias(c) for c in (*values, "matched_at")])


def _units(df: DataFrame, column: str) -> Column:
    """The column as whole units: microseconds, days or the integer itself."""
    kind, col = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint")
    raise ValueError(f"{column} is neither a time nor an integer")


def interval_join(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, grain: int | None = None
) -> DataFrame:
    """Every pair of a point and a span of equal keys with start <= at < end: (point columns…, other span columns…).

    Time is cut into cells of ``grain`` units, and cells into nodes of 1, 2, 4, … cells.  A span becomes the few
    nodes that cover it, at most two of each size, and a point the nodes of all sizes around it, so both grow with
    the logarithm of the longest span and a pair meets in exactly one node: an equi-join, however long the spans
    and however hot a key.  Only pairs in the cells at a span's edges are compared in vain; without
    ``grain`` a cell is about an eighth of the mean span.

    Null keys equal each other.  Null times and spans that end no later than they start have no partner; repeated
    rows are pairs of their own; an empty side gives no rows.  The three times must be of one type.
    """
    keys = list(keys)
    if len({points.schema[at].dataType, spans.schema[start].dataType, spans.schema[end].dataType}) > 1:
        raise ValueError("the times differ in type")
    clash = sorted({c.lower() for c in points.columns} & {c.lower() for c in spans.columns if c not in keys})
    if clash:
        raise ValueError(f"both sides have the columns {clash}")
    own = [c for c in spans.columns if c not in keys]
    sides = spans.select(
        F.struct(*[F.col(f"`{c}`") for c in keys]).alias("_k") if keys else F.lit(0).alias("_k"),
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_span"), _units(spans, start).alias("_s"), _units(spans, end).alias("_e"),
    ).filter(F.col("_s") < F.col("_e"))
    dots = points.select(
        F.struct(*[F.col(f"`{c}`") for c in keys]).alias("_k") if keys else F.lit(0).alias("_k"),
        F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point"), _units(points, at).alias("_t"),
    ).filter(F.col("_t").isNotNull())
    length = F.col("_e") - F.col("_s")
    mean, longest = sides.agg(F.avg(length), F.max(length)).first()  # two numbers
    cell = max(1, int(grain) if grain else int((mean or 0) // 8))
    levels = max(1, ((longest or 1) // cell + 2).bit_length())
    low, high = "shiftright(_a + shiftleft(1L, l) - 1, l)", "shiftright(_b, l)"
    nodes = F.expr(f"""filter(flatten(transform(sequence(0, {levels - 1}), l -> array(
        if({low} < {high} and {low} & 1 = 1, named_struct('level', l, 'node', {low}), null),
        if({low} < {high} and {high} & 1 = 1, named_struct('level', l, 'node', {high} - 1), null)))), n -> n is not null)""")
    covered = sides.withColumns({
        "_a": F.expr(f"(_s - pmod(_s, {cell}L)) div {cell}L"), "_b": F.expr(f"(_e - 1 - pmod(_e - 1, {cell}L)) div {cell}L + 1"),
    }).select("_k", "_span", "_s", "_e", F.inline(nodes))
    around = dots.withColumn("_c", F.expr(f"(_t - pmod(_t, {cell}L)) div {cell}L")).select(
        F.col("_k").alias("_pk"), "_point", "_t",
        F.expr(f"inline(transform(sequence(0, {levels - 1}), l -> named_struct('_level', l, '_node', shiftright(_c, l))))"),
    )
    met = around.join(
        covered,
        F.col("_pk").eqNullSafe(F.col("_k")) & (F.col("_level") == F.col("level")) & (F.col("_node") == F.col("node")),
    ).filter((F.col("_s") <= F.col("_t")) & (F.col("_t") < F.col("_e")))
    return met.select("_point.*", "_span.*")
