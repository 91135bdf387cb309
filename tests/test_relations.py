"""Sessions, as-of joins, cubes and table differences against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsight.operators import cubes, difference, intervals

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def log(spark):
    """One hot entity with two thirds of the rows, repeated times, an entity that is null."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        who = 1 if i % 3 else rng.choice([2, 3, None, (1 << 60) + 1])
        rows.append((i, who, at(rng.randrange(4000) * 10)))
    rows += [(2000, 1, at(50_000)), (2001, 1, at(50_030)), (2002, 1, at(50_061)), (2003, 2, None)]
    return rows, spark.createDataFrame(rows, "id long, who long, at timestamp_ntz").repartition(5)


def brute_sessions(rows, gap):
    found = []
    by_who = {}
    for _, who, when in rows:
        if when is not None:
            by_who.setdefault(who, []).append(when)
    for who, times in by_who.items():
        times.sort()
        run = [times[0]]
        for t in times[1:]:
            if (t - run[-1]).total_seconds() > gap:
                found.append((who, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        found.append((who, run[0], run[-1], len(run)))
    return Counter(found)


@pytest.mark.parametrize("size", [2, 37, None])
@pytest.mark.parametrize("gap", [30, 100_000])
def test_sessions(log, size, gap):
    rows, df = log
    got = intervals.sessions(df, ["who"], "at", ["id"], gap, block_size=size)
    assert got.columns == ["who", "session_start", "session_end", "entries"]
    assert Counter(tuple(r) for r in got.collect()) == brute_sessions(rows, gap)


def test_sessions_of_an_empty_log(spark, log):
    assert intervals.sessions(log[1].limit(0), ["who"], "at", ["id"], 5).count() == 0


@pytest.mark.parametrize("size", [2, 41, None])
@pytest.mark.parametrize("within", [None, 25])
def test_as_of(spark, log, size, within):
    rows, left = log
    rng = random.Random(5)
    offers = [(i, rng.choice([1, 1, 1, 2, 4, None]), at(rng.randrange(800) * 50), None if i % 7 == 0 else f"s{i}") for i in range(150)]
    offers += [(900, 1, at(4000), "low"), (901, 1, at(4000), "high"), (902, 2, None, "never")]
    right = spark.createDataFrame(offers, "rid long, who long, since timestamp_ntz, state string").repartition(3)
    want = Counter()
    for i, who, when in rows:
        fits = [(o[2], o[0], o[3]) for o in offers if who is not None and o[1] == who and when is not None and o[2] is not None and o[2] <= when]
        best = max(fits, default=None)
        if best and within is not None and (when - best[0]).total_seconds() > within:
            best = None
        want[i, who, when, best[2] if best else None, best[0] if best else None] += 1
    got = intervals.as_of(left, right, ["who"], "at", ["state"], ["rid"], right_ts="since", within_seconds=within, block_size=size)
    assert got.columns == ["id", "who", "at", "state", "matched_at"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_as_of_edges(spark, log):
    left = log[1]
    none = spark.createDataFrame([], "rid long, who long, at timestamp_ntz, state string")
    got = intervals.as_of(left, none, ["who"], "at", ["state"], ["rid"])
    assert got.count() == len(log[0]) and got.filter("state IS NOT NULL").count() == 0
    assert intervals.as_of(left.limit(0), none, ["who"], "at", ["state"], ["rid"]).count() == 0
    with pytest.raises(ValueError):
        intervals.as_of(left.withColumn("state", F.lit(1)), none, ["who"], "at", ["state"], ["rid"])


def test_sliding_windows(spark, log):
    rows, df = log
    got = intervals.sliding(df, "at", "60 seconds", "20 seconds", ["who"], [F.count("*").alias("n")])
    want = Counter()
    for _, who, when in rows:
        if when is not None:
            second = int((when - BASE).total_seconds())
            for back in range(3):
                start = second // 20 * 20 - 20 * back
                want[who, at(start), at(start + 60)] += 1
    assert {tuple(r)[:3]: r["n"] for r in got.collect()} == want


CELLS = [("a", 1, 5.0), ("a", None, 0.0), ("a", None, -0.0), (None, 1, float("nan")), (None, 1, float("nan")), (None, 1, None),
         ("b", (1 << 60) + 1, 2.5), ("b", (1 << 60) + 1, 2.5), (None, None, None)]


def test_table_diff(spark):
    schema = "s string, n long, v double"
    rng = random.Random(9)
    left = [rng.choice(CELLS) for _ in range(60)]
    right = [rng.choice(CELLS) for _ in range(60)] + [("b", (1 << 60) + 3, 2.5)]

    def key(r):
        return (r[0], r[1], "nan" if r[2] is not None and r[2] != r[2] else r[2])

    a, b = Counter(map(key, left)), Counter(map(key, right))
    want = {k: (a[k], b[k]) for k in a | b if a[k] != b[k]}
    frames = [spark.createDataFrame(rows, schema).repartition(4) for rows in (left, right)]
    for buckets in (1, 3, difference.BUCKETS):
        got = difference.table_diff(*frames, buckets=buckets).collect()
        assert {key(r): (r["left_n"], r["right_n"]) for r in got} == want


def test_table_diff_edges(spark):
    df = spark.createDataFrame(CELLS, "s string, n long, v double")
    assert difference.table_diff(df, df.repartition(3)).count() == 0
    missing = difference.table_diff(df, df.limit(0)).collect()
    assert sum(r["left_n"] for r in missing) == len(CELLS) and {r["right_n"] for r in missing} == {0}
    assert difference.table_diff(df.limit(0), df.limit(0)).count() == 0
    swapped = spark.createDataFrame([(None, "x"), ("x", None)], "p string, q string")
    turned = spark.createDataFrame([(None, "x"), (None, "x")], "p string, q string")
    assert {tuple(r) for r in difference.table_diff(swapped, turned).collect()} == {(None, "x", 1, 2), ("x", None, 1, 0)}
    with pytest.raises(ValueError):
        difference.table_diff(df, df.withColumn("n", F.col("n").cast("int")))
    with pytest.raises(ValueError):
        difference.table_diff(df.withColumn("left_n", F.lit(1)), df.withColumn("left_n", F.lit(1)))


def test_equal_buckets_are_not_shuffled_by_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    plan = difference.table_diff(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "broadcast" in plan.lower()


def test_levels():
    assert cubes.rollup_sets(["a", "b"]) == [("a", "b"), ("a",), ()]
    assert cubes.cube_sets(["a", "b"]) == [("a", "b"), ("a",), ("b",), ()]
    assert [cubes.level_id(["a", "b"], s) for s in cubes.cube_sets(["a", "b"])] == [0, 1, 2, 3]


def test_cube_with_null_keys(spark):
    big = (1 << 60) + 1
    rows = [("x", big, 1.0), ("x", big, 3.0), ("x", None, 8.0), (None, big + 2, 2.0), (None, None, None), ("y", None, float("nan"))]
    df = spark.createDataFrame(rows, "a string, b long, v double").repartition(3)
    got = cubes.grouping_stats(df, ["a", "b"], ["v"], probs=[0.5])
    found = {(r["grouping_id"], r["a"], r["b"]): (r["count"], r["sum"], r["min"], r["max"], r["q"][0]) for r in got.collect()}
    assert found == {
        (0, "x", big): (2, 4.0, 1.0, 3.0, 2.0), (0, "x", None): (1, 8.0, 8.0, 8.0, 8.0), (0, None, big + 2): (1, 2.0, 2.0, 2.0, 2.0),
        (1, "x", None): (3, 12.0, 1.0, 8.0, 3.0), (1, None, None): (1, 2.0, 2.0, 2.0, 2.0),
        (2, None, big): (2, 4.0, 1.0, 3.0, 2.0), (2, None, None): (1, 8.0, 8.0, 8.0, 8.0), (2, None, big + 2): (1, 2.0, 2.0, 2.0, 2.0),
        (3, None, None): (4, 14.0, 1.0, 8.0, 2.5),
    }
    assert cubes.grouping_stats(df.limit(0), ["a", "b"], ["v"]).count() == 0
    only = cubes.grouping_stats(df, ["a", "b"], ["v"], [("b",), ("b",)])
    assert {r["grouping_id"] for r in only.collect()} == {2} and only.count() == 3
    with pytest.raises(ValueError):
        cubes.grouping_stats(df, ["a"], ["v"], [("c",)])


@pytest.mark.parametrize("grain", [None, 1, 7, 10_000])
@pytest.mark.parametrize("keys", [["who"], []])
def test_interval_join(spark, keys, grain):
    rng = random.Random(5)
    who = lambda: rng.choice([1, 1, 1, 2, None, (1 << 60) + 1])
    points = [(i, who(), rng.randrange(-500, 3000)) for i in range(500)] + [(900, 1, None), (901, 1, 40), (901, 1, 40)]
    spans = []
    for i in range(120):
        s = rng.randrange(-600, 3000)
        spans.append((i, who(), s, s + rng.choice([-3, 0, 1, 2, 17, 250, 5000])))
    spans += [(500, 1, None, 7), (501, 1, 7, None), (502, 1, 39, 41), (502, 1, 39, 41)]
    left = spark.createDataFrame(points, "id long, who long, t long").repartition(4)
    right = spark.createDataFrame(spans, "span long, who long, s long, e long").repartition(3)
    if not keys:
        right = right.drop("who")
    got = Counter(tuple(r) for r in intervals.interval_join(left, right, keys, "t", "s", "e", grain).select("id", "span", "t", "s", "e").collect())
    want = Counter(
        (i, j, t, s, e) for i, a, t in points for j, b, s, e in spans
        if None not in (t, s, e) and s <= t < e and (a == b or not keys)
    )
    assert got == want


def test_interval_join_of_times_and_odd_sides(spark):
    left = spark.createDataFrame([(1, at(0)), (2, at(59)), (3, at(60)), (4, None)], "id long, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(0), at(60)), ("b", at(60), at(60)), ("c", at(-5), at(86_400 * 4000))], "name string, s timestamp_ntz, e timestamp_ntz")
    got = {(r["id"], r["name"]) for r in intervals.interval_join(left, right, [], "t", "s", "e").collect()}
    assert got == {(1, "a"), (2, "a"), (1, "c"), (2, "c"), (3, "c")}
    assert intervals.interval_join(left.limit(0), right, [], "t", "s", "e").count() == 0
    assert intervals.interval_join(left, right.limit(0), [], "t", "s", "e").columns == ["id", "t", "name", "s", "e"]
    assert intervals.interval_join(left, right.limit(0), [], "t", "s", "e").count() == 0
    with pytest.raises(ValueError):
        intervals.interval_join(left.withColumnRenamed("id", "Name"), right, [], "t", "s", "e")
    with pytest.raises(ValueError):
        intervals.interval_join(left.withColumn("t", F.col("t").cast("date")), right, [], "t", "s", "e")
