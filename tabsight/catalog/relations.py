"""Queries that relate rows to other rows or levels: sessions, as-of joins, cubes, table differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import long_sql, register, table
from tabsight.functions.columns import micros_between, rounded
from tabsight.operators import clean, cubes, difference, eventlog, intervals
from tabsight.operators.stats import AGGREGATION_QUANTILES
from tabsight.streaming import states
from tabsight.streaming.run import run_available

_GAP_SECONDS = 6 * 3600


@register(
    "sessions",
    f"""
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS entries FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {_GAP_SECONDS * 1_000_000}
                       THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"], _GAP_SECONDS)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream, in one micro-batch: its files need not be in time order."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


@register(
    "stream_sessions",
    f"""
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS entries FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {_GAP_SECONDS * 1_000_000}
                       THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session HAVING epoch_ms(max(ts)) + {_GAP_SECONDS * 1000} < (SELECT epoch_ms(max(ts)) FROM events)""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a stream over the events has closed."""
    found = states.session_stream(_event_stream(spark, sf_dir), ["user_id"], "ts", _GAP_SECONDS, "0 seconds")
    return run_available(found, "stream-sessions")


@register(
    "stream_state_duration",
    """
    SELECT user_id, state, round(sum(us) / 1e6::DOUBLE, 3) AS seconds FROM (
      SELECT user_id, event_type AS state, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us,
             lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until
      FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
      WHERE event_type IS DISTINCT FROM before)
    WHERE epoch_us(until) <= (SELECT (epoch_ms(max(ts)) - 1) * 1000 FROM events) GROUP BY 1, 2""",
)
def stream_state_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in each state that a stream over the events has seen end."""
    ended = states.time_in_state(_event_stream(spark, sf_dir), ["user_id"], "event_type", "ts", ["event_id"], "0 seconds")
    spans = run_available(ended, "stream-states")
    spent = spans.withColumn("_us", micros_between(F.col("from"), F.col("to")))
    return spent.groupBy("user_id", "state").agg(rounded(F.sum("_us") / 1e6, 3).alias("seconds"))


@register(
    "sliding_windows",
    """
    SELECT event_type, start AS window_start, start + INTERVAL 3 HOUR AS window_end, count(*) AS entries, round(sum(value), 4) AS total FROM (
      SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS start FROM events)
    GROUP BY 1, 2""",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [F.count("*").alias("entries"), F.sum("value").alias("total")]
    moving = intervals.sliding(table(spark, sf_dir, "events"), "ts", "3 hours", "1 hour", ["event_type"], wanted)
    return moving.withColumn("total", rounded("total", 4))


_STATES = ("signup", "purchase")


@register(
    "state_as_of",
    """
    WITH log AS (SELECT * FROM events WHERE event_type IN ('signup', 'purchase')),
    changes AS (SELECT * FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM log) WHERE event_type IS DISTINCT FROM before),
    states AS (SELECT user_id, ts, max_by(event_type, event_id) AS state FROM changes GROUP BY 1, 2)
    SELECT m.event_id, m.user_id, m.ts, m.event_type, s.state, s.ts AS matched_at
    FROM (SELECT * FROM events WHERE event_type NOT IN ('signup', 'purchase')) m
    ASOF LEFT JOIN states s ON m.user_id = s.user_id AND m.ts >= s.ts""",
)
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state a user is in (signed up, bought) at each of the other events."""
    events = table(spark, sf_dir, "events")
    in_state = F.col("event_type").isin(*_STATES)
    changes = eventlog.state_changes(events.filter(in_state), ["user_id"], "event_type", "ts", ["event_id"])
    messages = events.filter(~in_state).select("event_id", "user_id", "ts", "event_type")
    states = changes.withColumnRenamed("event_type", "state")
    return intervals.as_of(messages, states, ["user_id"], "ts", ["state"], ["event_id"])


_QUANTILES = ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{int(q * 100)}" for q in AGGREGATION_QUANTILES)
_CELLS = long_sql("lineitem", {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice"}, "l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS line")


def _levels_sql(keys: str, grouping: str) -> str:
    return f"""
    SELECT grouping_id({keys}) AS grouping_id, {keys}, "column", count(*) AS count, round(sum(value), 2) AS sum,
           round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, {_QUANTILES}
    FROM ({_CELLS}) GROUP BY {grouping}"""


def _levels(df: DataFrame, keys: list[str]) -> DataFrame:
    quantiles = [rounded(F.col("q")[i]).alias(f"q{int(q * 100)}") for i, q in enumerate(AGGREGATION_QUANTILES)]
    fine = [F.col("grouping_id").cast("bigint").alias("grouping_id"), *keys, "column", "count"]
    return df.select(*fine, rounded("sum", 2).alias("sum"), rounded("mean").alias("mean"), "min", "max", *quantiles)


@register("agg_cube", _levels_sql("l_returnflag, l_linestatus", 'CUBE (l_returnflag, l_linestatus), "column"'))
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    return _levels(cubes.grouping_stats(table(spark, sf_dir, "lineitem"), keys, ["l_quantity", "l_extendedprice"]), keys)


@register("agg_rollup", _levels_sql("l_returnflag, line", 'ROLLUP (l_returnflag, line), "column"'))
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag", "line"]
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber").cast("string"))
    return _levels(cubes.grouping_stats(lines, keys, ["l_quantity", "l_extendedprice"], cubes.rollup_sets(keys)), keys)


@register(
    "table_diff",
    """
    WITH raw AS (
      SELECT user_id, value, CASE event_type WHEN 'error' THEN '   ' WHEN 'view' THEN ' view' ELSE event_type END AS label FROM events),
    clean AS (SELECT user_id, value, nullif(trim(label), '') AS label FROM raw),
    sides AS (SELECT *, 1 AS l, 0 AS r FROM raw UNION ALL SELECT *, 0, 1 FROM clean)
    SELECT user_id, value, label, CAST(sum(l) AS BIGINT) AS left_n, CAST(sum(r) AS BIGINT) AS right_n
    FROM sides GROUP BY ALL HAVING sum(l) <> sum(r)""",
)
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that general normalisation changes, as they were and as they are."""
    kind = F.col("event_type")
    label = F.when(kind == "error", "   ").when(kind == "view", " view").otherwise(kind)
    raw = table(spark, sf_dir, "events").select("user_id", "value", label.alias("label"))
    return difference.table_diff(raw, clean.general_normalize(raw))


@register(
    "after_errors",
    """
    SELECT e.user_id, e.event_id, e.event_type, x.event_id AS error_id FROM events e JOIN events x
    ON e.user_id IS NOT DISTINCT FROM x.user_id AND x.event_type = 'error' AND e.ts >= x.ts AND e.ts < x.ts + INTERVAL 12 HOUR""",
)
def after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with what its user did in the twelve hours from it on."""
    events = table(spark, sf_dir, "events")
    errors = events.filter(F.col("event_type") == "error").select(
        "user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("opened"), (F.col("ts") + F.expr("INTERVAL 12 HOUR")).alias("closed")
    )
    met = intervals.interval_join(events.select("user_id", "event_id", "event_type", "ts"), errors, ["user_id"], "ts", "opened", "closed")
    return met.select("user_id", "event_id", "event_type", "error_id")


@register(
    "open_orders",
    """
    SELECT d.day, count(*) AS items, round(sum(l.l_quantity), 2) AS quantity
    FROM (SELECT DISTINCT l_shipdate AS day FROM lineitem) d JOIN lineitem l
    ON l.l_shipdate <= d.day AND d.day < l.l_shipdate + INTERVAL 30 DAY GROUP BY 1""",
)
def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on its way each day, with thirty days for every shipment: no key, equal spans counted before the join."""
    lines = table(spark, sf_dir, "lineitem")
    days = lines.select(F.col("l_shipdate").alias("day")).distinct()
    sent = lines.groupBy(F.col("l_shipdate").alias("sent")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    sent = sent.withColumn("until", (F.col("sent") + F.expr("INTERVAL 30 DAY")).cast(sent.schema["sent"].dataType))
    met = intervals.interval_join(days, sent, [], "day", "sent", "until")
    return met.groupBy("day").agg(F.sum("n").alias("items"), rounded(F.sum("q"), 2).alias("quantity"))
