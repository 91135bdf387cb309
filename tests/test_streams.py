"""Streams of files in shuffled order give the rows of the batch operators."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsight.operators import eventlog, intervals
from tabsight.streaming import states
from tabsight.streaming.run import PROVIDER

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id long, who long, state string, at timestamp_ntz"
BIG = (1 << 60) + 1
END = 40_000


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def batches():
    """300 entries in time order, swapped within a window of 20, in files of 60; then two rows that move the watermark."""
    rng = random.Random(11)
    rows = [(i, rng.choice([1, 1, 1, 2, BIG, BIG + 2]), rng.choice(["a", "b", None]), at(100 * (i // 2))) for i in range(300)]
    mixed = sorted(rows, key=lambda r: r[0] + rng.randrange(20))
    files = [mixed[i : i + 60] for i in range(0, 300, 60)]
    return rows, files


def run(spark, tmp_path, files, build):
    """One micro-batch per file, with a restart before the last one."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    spark.conf.set(PROVIDER, states.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    late = 0
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
        for part in (range(len(files) - 1), range(len(files) - 1, len(files))):
            for n in part:
                spark.createDataFrame(files[n], SCHEMA).coalesce(1).write.parquet(str(source / f"{n:03d}"))
            query = (
                build(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
                .trigger(availableNow=True).start(str(out))
            )
            query.awaitTermination(200)
            late += states.late_rows(query)
        return spark.read.schema(build(stream).schema).parquet(str(out)), late
    finally:
        spark.conf.unset(PROVIDER)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_time_in_state_on_a_stream(spark, tmp_path, batches):
    rows, files = batches
    ends = [(1000 + i, who, "end", at(END)) for i, who in enumerate((1, 2, BIG, BIG + 2))]
    movers = [[(2000, 9, "x", at(END + 9000))], [(2001, 9, "y", at(END + 90_000))], [(2002, 1, "late", at(5))]]
    got, late = run(
        spark, tmp_path, [*files, ends, *movers],
        lambda s: states.time_in_state(s, ["who"], "state", "at", ["id"], "2000 seconds"),
    )
    assert got.columns == ["who", "state", "from", "to"] and dict(got.dtypes)["from"] == "timestamp_ntz"
    assert late == 1
    spent = Counter()
    for r in got.filter(F.col("who") != 9).collect():
        spent[r["who"], r["state"]] += (r["to"] - r["from"]).total_seconds()
    df = spark.createDataFrame(rows, SCHEMA)
    changes = eventlog.state_changes(df, ["who"], "state", "at", ["id"])
    want = eventlog.state_duration(changes, ["who"], "state", "at", ["id"], F.lit(str(at(END))).cast("timestamp_ntz"))
    assert {k: v for k, v in spent.items() if v} == {(r["who"], r["state"]): r["seconds"] for r in want.collect()}


def test_sessions_on_a_stream(spark, tmp_path, batches):
    rows, files = batches
    movers = [[(2000, 9, "x", at(END + 9000))], [(2001, 9, "y", at(END + 90_000))]]
    got, _ = run(spark, tmp_path, [*files, *movers], lambda s: states.session_stream(s, ["who"], "at", 200, "2000 seconds"))
    want = intervals.sessions(spark.createDataFrame(rows, SCHEMA), ["who"], "at", ["id"], 200)
    columns = ["who", "session_start", "session_end", "entries"]
    assert Counter(map(tuple, got.filter("who <> 9").select(*columns).collect())) == Counter(map(tuple, want.select(*columns).collect()))


def test_sliding_windows_on_a_stream(spark, tmp_path, batches):
    rows, files = batches
    movers = [[(2000, 9, "x", at(END + 9000))], [(2001, 9, "y", at(END + 90_000))]]
    build = lambda s: intervals.sliding(s.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "2000 seconds") if s.isStreaming else s, "at", "10 minutes", "5 minutes", ["who"], [F.count("*").alias("n")])
    got, _ = run(spark, tmp_path, [*files, *movers], build)
    want = build(spark.createDataFrame(rows, SCHEMA))
    got = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    assert Counter(map(tuple, got.filter("who <> 9").collect())) == Counter(map(tuple, want.collect()))


class _Kept:
    """A state variable in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def appendValue(self, row):
        self.calls.append(1)
        self.rows.append(row)

    def update(self, row):
        self.calls.append(1)
        self.rows = [row]

    def get(self):
        self.calls.append(1)
        return iter(self.rows) if len(self.rows) and isinstance(self.rows[0][0], list) else self.rows[0]

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.calls = []

    def getListState(self, name, schema):
        return _Kept(self.calls)

    def getValueState(self, name, schema):
        return _Kept(self.calls)

    def registerTimer(self, ms):
        self.calls.append(1)

    def deleteTimer(self, ms):
        self.calls.append(1)


def test_calls_to_the_state_do_not_grow_with_the_entries_of_an_entity():
    from types import SimpleNamespace

    from pyspark.sql import types as T

    def settled(n):
        handle, processor = _Handle(), states._TimeInState(T.StringType(), [T.StructField("id", T.LongType())], ["who"])
        processor.init(handle)
        rows = [(7, None, 1_000_000 * i, "ab"[i // 3 % 2] if i % 5 else None, i) for i in range(n)]
        mixed = rows[::2] + rows[1::2] + rows[:4]  # some come twice
        processor.handleInputRows((7,), iter(mixed[: n // 2]), None)
        processor.handleInputRows((7,), iter(mixed[n // 2 :]), None)
        out = []
        for seconds in (n // 2, n + 1):
            out += processor.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda s=seconds: s * 1000), None)
        changes = [r for i, r in enumerate(rows) if not i or r[3] != rows[i - 1][3]]
        assert [tuple(r) for r in out] == [(7, a[3], a[2], b[2]) for a, b in zip(changes, changes[1:])]
        return len(handle.calls)

    assert settled(2000) == settled(200) < 20
