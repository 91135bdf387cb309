"""Time in state and sessions on streams: the rows of the batch operators, as soon as time has passed them.

Both need a watermark.  Entries later than it allows are left out and counted in the query's
progress (``late_rows``).  Time in state keeps its state in RocksDB: set
``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB`` before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_TOGETHER = 10_000  # entries handed to the state in one call
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _TimeInState(StatefulProcessor):
    """One entity: entries wait until the watermark has passed them, then follow each other in time order.

    One timer per entity stands at its earliest waiting entry.  It fires once the watermark is beyond its
    millisecond, and every entry that far back is settled: one whose state differs from the open entry closes it, which gives a row.
    Nothing that old can still arrive, so the order is final.  Kept are the open entry and what waits.
    """

    def __init__(self, state_type: T.DataType, ids: Sequence[T.StructField], entity: Sequence[str]) -> None:
        self.keys = len(entity)
        self.out = Row(*entity, "state", "_from", "_to")
        kinds = {"at": T.LongType(), **{f"id{i}": f.dataType for i, f in enumerate(ids)}, "state": state_type}
        self.pending_schema = T.StructType([T.StructField(c, T.ArrayType(kind)) for c, kind in kinds.items()])
        self.open_schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("state", state_type)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.pending_schema)
        self.open = handle.getValueState("open", self.open_schema)
        self.alarm = handle.getValueState("alarm", "ms long")

    def _wake(self, at: int) -> None:
        """Keep one timer, at the first millisecond not before ``at``."""
        ms = -(-at // 1000)
        if self.alarm.exists():
            before = self.alarm.get()[0]
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def _wait(self, arrived: list[tuple]) -> None:
        """Entries go to the state together, one list per field: a call, and a row of the state, cost more than an entry."""
        self.pending.appendValue(tuple(map(list, zip(*arrived, strict=True))))
        self._wake(min(entry[0] for entry in arrived))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """Rows are (entity…, time, micros, state, ids…)."""
        arrived = []
        for row in rows:
            at, state, *ids = tuple(row)[self.keys + 1 :]
            arrived.append((at, *ids, state))
            if len(arrived) == _TOGETHER:
                self._wait(arrived)
                arrived = []
        if arrived:
            self._wait(arrived)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.alarm.clear()
        passed = (timerValues.getCurrentWatermarkInMs() - 1) * 1000
        # of entries that repeat the last one counts
        waiting = {entry[:-1]: entry[-1] for some in self.pending.get() for entry in zip(*some, strict=True)}
        ready = [w for w in waiting.items() if w[0][0] <= passed]
        ready.sort(key=lambda w: [(part is not None, part) for part in w[0]])
        held = tuple(self.open.get()) if self.open.exists() else None
        closed = []
        for place, state in ready:
            if held is None or held[1] != state:
                if held is not None:
                    closed.append(self.out(*key, held[1], held[0], place[0]))
                held = (place[0], state)
        if ready:
            self.open.update(held)
        left = [(*place, state) for place, state in waiting.items() if place[0] > passed]
        self.pending.clear()
        for start in range(0, len(left), _TOGETHER):
            self._wait(left[start : start + _TOGETHER])
        return iter(closed)

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Entries that have a time, as an instant (a watermark takes no other type)."""
    return stream.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def time_in_state(stream: DataFrame, entity: Sequence[str], state: str, ts: str, ids: Sequence[str], delay: str) -> DataFrame:
    """(entity…, state, from, to) of every state that a later entry has ended.

    Entries may come in any order within ``delay``.  Ties in time go by ``ids``, as in ``state_changes``; an
    entry that repeats with the same time and ids counts once.  Seconds summed over these rows are those of
    ``state_duration``, but for the states still open.  Entries without a time are left out; a null state is a
    state, a null entity an entity.  Times without a zone are read in the session's zone: keep it at UTC.
    """
    entity, ids = list(entity), list(ids)
    fields = {f.name: f for f in stream.schema.fields}
    kind = fields[ts].dataType
    timed = _timed(stream, ts, delay).select(*entity, ts, F.unix_micros(ts).alias("_at"), state, *ids)
    processor = _TimeInState(fields[state].dataType, [T.StructField(c, fields[c].dataType) for c in ids], entity)
    long = T.LongType()
    schema = T.StructType(
        [*[fields[c] for c in entity], T.StructField("state", fields[state].dataType), T.StructField("_from", long), T.StructField("_to", long)]
    )
    closed = timed.groupBy(*entity).transformWithState(processor, schema, "Append", "EventTime")
    moment = lambda c: F.timestamp_micros(c).cast(kind)
    return closed.select(*entity, "state", moment("_from").alias("from"), moment("_to").alias("to"))


def session_stream(stream: DataFrame, entity: Sequence[str], ts: str, gap_seconds: float, delay: str) -> DataFrame:
    """(entity…, session_start, session_end, entries): the sessions of ``intervals.sessions``, once the watermark has passed their gap.

    Entries without a time are left out; times without a zone are read in the session's zone: keep it at UTC.
    """
    entity = list(entity)
    kind = stream.schema[ts].dataType
    timed = _timed(stream, ts, delay)
    gap = f"{int(gap_seconds * 1_000_000)} microseconds"
    merged = timed.groupBy(F.session_window(ts, gap).alias("_w"), *entity).agg(
        F.min(ts).cast(kind).alias("session_start"), F.max(ts).cast(kind).alias("session_end"), F.count("*").alias("entries")
    )
    return merged.drop("_w")


def late_rows(query: StreamingQuery) -> int:
    """Entries the watermark left out, over the progress the query still holds."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
