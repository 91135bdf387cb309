"""State logs, message history and record validation."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tabsight.operators import eventlog
from tabsight.streaming.records import split_records

GOOD = {
    "sender": "collector", "recipient": "analyzer", "message_type": "REQUEST", "content": {"data": "sample"},
    "timestamp": "2024-01-01T10:00:00.123456", "correlation_id": "c-1", "priority": "MEDIUM",
}


def _errors(spark, *records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    df = eventlog.validate_records(spark.createDataFrame(rows, "i int, json string"), "json")
    return [r["errors"] for r in df.orderBy("i").collect()]


def test_record_validation(spark):
    bad_all = {**GOOD, "sender": "", "recipient": 5, "message_type": "SHOUT", "content": "text", "priority": None,
               "correlation_id": 7, "timestamp": "01.01.2024"}
    missing = {k: v for k, v in GOOD.items() if k not in ("priority", "content")}
    got = _errors(spark, GOOD, bad_all, missing, "not json", "[1]", {**GOOD, "timestamp": "2024-13-40T00:00:00"},
                  {**GOOD, "timestamp": "2024-01-01", "content": {}})
    assert got[0] == []
    assert got[1] == [
        "Sender must be a non-empty string", "Recipient must be a non-empty string", "Invalid message type: SHOUT",
        "Invalid priority: None", "Content must be a dictionary", "Correlation ID must be a string",
        "Timestamp must be a valid ISO format datetime string",
    ]
    assert got[2] == ["Missing required fields: content, priority"]
    assert got[3] == ["Invalid JSON"] and got[4] == ["Invalid JSON"]
    assert len(got[5]) == 1 and got[6] == []


def test_decode_encode_round_trip(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD)), (2, "oops")], "i int, json string")
    decoded = eventlog.decode_records(df, "json").drop("json")
    assert decoded.count() == 1 and decoded.first()["content"] == {"data": "sample"}
    again = json.loads(eventlog.encode_records(decoded).first()["json"])
    assert again == GOOD


def test_a_filter_on_validity_parses_a_record_once(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD)), (2, "oops"), (3, None)], "i int, json string")
    valid = eventlog.validate_records(df, "json").filter("is_valid")
    plan = valid._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1
    assert [r["i"] for r in valid.collect()] == [1]


def test_split_on_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text(json.dumps(GOOD) + "\nnope\n" + json.dumps({**GOOD, "priority": "LOW"}) + "\n")
    stream = spark.readStream.schema("value string").text(str(source))
    valid, quarantined = split_records(stream, "value")
    for name, frame in (("valid", valid), ("bad", quarantined)):
        q = (frame.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp-{name}"))
             .trigger(availableNow=True).start(str(out / name)))
        q.awaitTermination(120)
    assert spark.read.parquet(str(out / "valid")).count() == 2
    assert spark.read.parquet(str(out / "bad")).first()["errors"] == ["Invalid JSON"]


@pytest.fixture(scope="module")
def log(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i < 900 else 2 + i % 3, "ABBCA"[i % 5] if i != 7 else None, base + dt.timedelta(seconds=10 * i)) for i in range(1000)]
    return rows, spark.createDataFrame(rows, "id long, who long, state string, at timestamp_ntz").repartition(6)


@pytest.mark.parametrize("size", [3, 64, None])
def test_state_changes_and_durations(log, size):
    rows, df = log
    want, spent, last = [], {}, {}
    for i, who, state, at in rows:
        if who not in last or last[who][0] != state:
            if who in last:
                key = (who, last[who][0])
                spent[key] = spent.get(key, 0) + (at - last[who][1]).total_seconds()
            want.append(i)
            last[who] = (state, at)
    now = rows[-1][3] + dt.timedelta(hours=1)
    for who, (state, at) in last.items():
        spent[who, state] = spent.get((who, state), 0) + (now - at).total_seconds()
    changes = eventlog.state_changes(df, ["who"], "state", "at", ["id"], block_size=size)
    assert sorted(r["id"] for r in changes.collect()) == want
    until = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    got = eventlog.state_duration(changes, ["who"], "state", "at", ["id"], until, block_size=size)
    assert {(r["who"], r["state"]): r["seconds"] for r in got.collect()} == pytest.approx(spent)


def test_history_recent_latest(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "b"), (3, "c", "a")], "n int, sender string, recipient string")
    history = eventlog.history_by_party(df, "sender", "recipient")
    assert sorted(r["n"] for r in history.filter("party = 'b'").collect()) == [1, 2, 2]
    assert [r["n"] for r in eventlog.recent(df, ["n"], 2).orderBy("n").collect()] == [2, 3]
    assert sorted(r["n"] for r in eventlog.recent(df, ["n"], 1, ["sender"]).collect()) == [1, 2, 3]
    writes = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, None)], "key string, t int, v string")
    assert {r["key"]: r["v"] for r in eventlog.latest_per_key(writes, "key", ["t"]).collect()} == {"k": "new", "j": None}


def test_recent_limits_before_the_shuffle(log):
    _, df = log
    plan = eventlog.recent(df, ["at", "id"], 3, ["who"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_embedded_json(spark):
    texts = ['Sure! {"a": 1, "b": {"c": "x"}} done', "no json", "{broken} {", 'two {"a": 2} and {"a": 3}', 'list [1, 2] end']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    empty = F.struct(F.lit(-1).cast("int").alias("a"))
    got = [r[0]["a"] for r in df.select(eventlog.embedded_json(F.col("t"), "struct<a:int>", empty)).collect()]
    assert got == [1, -1, -1, -1, -1]
    lists = [r[0] for r in df.select(eventlog.embedded_json(F.col("t"), "array<int>", F.array().cast("array<int>"), array=True)).collect()]
    assert lists == [[], [], [], [], [1, 2]]
