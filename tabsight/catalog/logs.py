"""Message and state log queries on events and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import register, table
from tabsight.functions.columns import rounded
from tabsight.operators import eventlog

_CHANGES_SQL = """
SELECT user_id, event_type, ts, event_id FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1 OR event_type IS DISTINCT FROM before"""
_NOW = "2024-02-01 00:00:00"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.state_changes(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", ["event_id"])


@register("state_changes", _CHANGES_SQL)
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@register(
    "state_duration",
    f"""
    SELECT user_id, event_type, round(sum(us) / 1e6::DOUBLE, 3) AS seconds FROM (
      SELECT *, epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '{_NOW}')) - epoch_us(ts) AS us
      FROM ({_CHANGES_SQL})) GROUP BY 1, 2 HAVING sum(us) > 0""",
)
def state_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    spent = eventlog.state_duration(_changes(spark, sf_dir), ["user_id"], "event_type", "ts", ["event_id"], now)
    return spent.withColumn("seconds", rounded("seconds", 3))


_MESSAGES_SQL = """
SELECT conv_id, turn, role AS sender, CASE WHEN role = 'user' THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS recipient,
       text FROM conversations"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    recipient = F.when(role == "user", "assistant").when(role == "system", "system").otherwise("user")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", role.alias("sender"), recipient.alias("recipient"), "text"
    )


@register(
    "history_by_party",
    f"""
    SELECT party, conv_id, turn, sender, recipient FROM (
      SELECT *, unnest([sender, recipient]) AS party FROM ({_MESSAGES_SQL}))""",
)
def history_by_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = eventlog.history_by_party(_messages(spark, sf_dir), "sender", "recipient")
    return history.select("party", "conv_id", "turn", "sender", "recipient")


@register("recent_n", f"SELECT conv_id, turn, sender FROM ({_MESSAGES_SQL}) ORDER BY conv_id DESC, turn DESC LIMIT 10")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.recent(_messages(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "sender")


@register(
    "recent_n_by_party",
    """
    SELECT user_id, event_id, recency FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events) WHERE recency <= 10""",
)
def recent_n_by_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = eventlog.recent(table(spark, sf_dir, "events"), ["ts", "event_id"], party=["user_id"])
    return latest.select("user_id", "event_id", F.col("recency").cast("bigint").alias("recency"))


@register(
    "latest_per_key",
    """
    SELECT user_id, event_id, ts, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return eventlog.latest_per_key(writes, "user_id", ["ts", "event_id"])


@register(
    "log_summary",
    f"""
    SELECT count(*) AS total_messages, count(DISTINCT user_id) AS parties,
           (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS current_state,
           (SELECT count(*) FROM ({_CHANGES_SQL})) AS state_changes FROM events""",
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.log_summary(
        table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], _changes(spark, sf_dir)
    )


def _quoted(value: str | Column) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit('"'), value, F.lit('"'))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record per event; which fields are damaged follows from the event."""
    kind, value = F.col("event_type"), F.col("value")
    sender = _quoted(F.when(kind == "error", "").otherwise(F.concat(F.lit("user"), F.col("user_id"))))
    content = F.when(kind == "view", F.lit('"text"')).otherwise(F.concat(F.lit('{"value": '), value.cast("string"), F.lit("}")))
    stamp = F.when(kind == "signup", F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    message = F.when(value > 100, "SHOUT").otherwise("REQUEST")
    correlation = F.when(value < 5, F.lit("7")).otherwise(_quoted("c1"))
    priority = F.when(value < 1, F.lit("")).otherwise(F.concat(F.lit(', "priority": '), _quoted("HIGH")))
    body = F.concat(
        F.lit('{"sender": '), sender, F.lit(', "recipient": "hub", "message_type": '), _quoted(message),
        F.lit(', "content": '), content, F.lit(', "timestamp": '), _quoted(stamp),
        F.lit(', "correlation_id": '), correlation, priority,
    )
    closed = F.when(value > 300, body).otherwise(F.concat(body, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", closed.alias("json"))


_ERRORS_SQL = """
SELECT event_id, CASE WHEN value > 300 THEN 'Invalid JSON' WHEN value < 1 THEN 'Missing required fields: priority' ELSE
  concat_ws('; ',
    CASE WHEN event_type = 'error' THEN 'Sender must be a non-empty string' END,
    CASE WHEN value > 100 THEN 'Invalid message type: SHOUT' END,
    CASE WHEN event_type = 'view' THEN 'Content must be a dictionary' END,
    CASE WHEN value < 5 THEN 'Correlation ID must be a string' END,
    CASE WHEN event_type = 'signup' THEN 'Timestamp must be a valid ISO format datetime string' END) END AS errors
FROM events"""


@register("validate_records", f"SELECT event_id, errors, errors = '' AS is_valid FROM ({_ERRORS_SQL})")
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = eventlog.validate_records(_records(spark, sf_dir), "json")
    return checked.select("event_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@register(
    "record_roundtrip",
    f"""
    SELECT e.event_id, 'user' || user_id AS sender, 'hub' AS recipient, 'REQUEST' AS message_type, value,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", 'HIGH' AS priority, 0::BIGINT AS errors_after
    FROM events e JOIN ({_ERRORS_SQL}) c ON e.event_id = c.event_id WHERE errors = ''""",
)
def record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = eventlog.decode_records(_records(spark, sf_dir), "json").drop("json")
    encoded = eventlog.encode_records(decoded).select("event_id", "json")
    again = eventlog.validate_records(encoded, "json")
    back = again.withColumn("record", F.from_json("json", eventlog.RECORD_SCHEMA))
    return back.select(
        "event_id", "record.sender", "record.recipient", "record.message_type",
        F.try_element_at("record.content", F.lit("value")).cast("double").alias("value"),
        "record.timestamp", "record.priority", F.size("errors").cast("bigint").alias("errors_after"),
    )


_WRAPPED_SQL = """
SELECT doc_id, n_chars, lang, CASE WHEN lang = 'fr' THEN text
  WHEN lang = 'de' THEN text || ' {"n_chars": ' || n_chars || ' oops} ' || source
  ELSE text || ' {"n_chars": ' || n_chars || ', "inner": {"lang": "' || lang || '"}} ' || source END AS reply
FROM documents"""


@register(
    "extract_json",
    f"""
    SELECT doc_id, coalesce(CAST(json_extract(found, '$.n_chars') AS BIGINT), -1) AS n_chars,
           coalesce(json_extract_string(found, '$.inner.lang'), 'none') AS lang FROM (
      SELECT doc_id, CASE WHEN json_valid(cut) THEN cut END AS found FROM (
        SELECT doc_id, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}', 0), '') AS cut FROM ({_WRAPPED_SQL})))""",
)
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, size = F.col("lang"), F.col("n_chars").cast("string")
    reply = (
        F.when(lang == "fr", F.col("text"))
        .when(lang == "de", F.concat("text", F.lit(' {"n_chars": '), size, F.lit(" oops} "), "source"))
        .otherwise(
            F.concat("text", F.lit(' {"n_chars": '), size, F.lit(', "inner": {"lang": "'), lang, F.lit('"}} '), "source")
        )
    )
    replies = table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))
    default = F.struct(F.lit(None).cast("bigint").alias("n_chars"), F.struct(F.lit(None).cast("string").alias("lang")).alias("inner"))
    found = eventlog.embedded_json(F.col("reply"), "struct<n_chars:bigint,inner:struct<lang:string>>", default)
    parsed = replies.select("doc_id", found.alias("found"))
    return parsed.select(
        "doc_id", F.coalesce("found.n_chars", F.lit(-1)).cast("bigint").alias("n_chars"),
        F.coalesce("found.inner.lang", F.lit("none")).alias("lang"),
    )
