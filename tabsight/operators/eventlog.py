"""Questions to message and state logs held as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsight.functions.columns import micros_between
from tabsight.operators.ordered import ORDINAL, block_window, blocks, number_rows

RECENT = 10
# The message record and the messages about its errors.
REQUIRED_FIELDS = ("sender", "recipient", "message_type", "content", "timestamp", "correlation_id", "priority")
MESSAGE_TYPES = ("REQUEST", "RESPONSE", "NOTIFICATION", "ERROR")
MESSAGE_PRIORITIES = ("HIGH", "MEDIUM", "LOW")
ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
INVALID_JSON = "Invalid JSON"
MISSING_FIELDS = "Missing required fields: "
EMPTY_SENDER = "Sender must be a non-empty string"
EMPTY_RECIPIENT = "Recipient must be a non-empty string"
BAD_TYPE = "Invalid message type: "
BAD_PRIORITY = "Invalid priority: "
BAD_CONTENT = "Content must be a dictionary"
BAD_CORRELATION = "Correlation ID must be a string"
BAD_TIMESTAMP = "Timestamp must be a valid ISO format datetime string"

RECORD_SCHEMA = (
    "sender string, recipient string, message_type string, content map<string,string>, timestamp string, "
    "correlation_id string, priority string"
)


def state_changes(
    log: DataFrame, entity: Sequence[str], state: str, ts: str, ids: Sequence[str], block_size: int | None = None
) -> DataFrame:
    """Entries whose state differs from the entity's state before, the first one included."""
    rows = number_rows(log.select(*entity, state, ts, *ids), [*entity, ts, *ids])
    placed = blocks(rows, before=1, size=block_size)
    w = block_window(entity)
    placed = placed.withColumn("_previous", F.lag(state).over(w)).withColumn("_first", F.lag(ORDINAL).over(w).isNull())
    changed = F.col("_first") | ~F.col(state).eqNullSafe(F.col("_previous"))
    return placed.filter(~F.col("_halo") & changed).select(*entity, state, ts, *ids)


def state_duration(
    changes: DataFrame, entity: Sequence[str], state: str, ts: str, ids: Sequence[str], now: Column, block_size: int | None = None
) -> DataFrame:
    """(entity…, state, seconds): time from each change to the next, the last one up to ``now``; zero is left out."""
    rows = number_rows(changes.select(*entity, state, ts, *ids), [*entity, ts, *ids])
    placed = blocks(rows, after=1, size=block_size)
    until = F.coalesce(F.lead(ts).over(block_window(entity)), now)
    timed = placed.withColumn("_us", micros_between(F.col(ts), until)).filter(~F.col("_halo"))
    sums = timed.groupBy(*entity, state).agg((F.sum("_us") / 1e6).alias("seconds"))
    return sums.filter(F.col("seconds") > 0)


def history_by_party(log: DataFrame, sender: str, recipient: str) -> DataFrame:
    """Every entry once under its sender and once under its recipient (twice when they are the same)."""
    return log.withColumn("party", F.explode(F.array(sender, recipient)))


def recent(log: DataFrame, order_by: Sequence[str], n: int = RECENT, party: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` entries, overall or per party; a partial limit runs before any shuffle."""
    latest = [F.desc(c) for c in order_by]
    if not party:
        return log.orderBy(*latest).limit(n)
    ranked = log.withColumn("recency", F.row_number().over(W.partitionBy(*party).orderBy(*latest)))
    return ranked.filter(F.col("recency") <= n)


def latest_per_key(log: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The last write of each key with all its fields."""
    others = [c for c in log.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order_by)).alias("_last")
    return log.groupBy(key).agg(last).select(key, "_last.*")


def log_summary(log: DataFrame, party: str, state: str, order_by: Sequence[str], changes: DataFrame) -> DataFrame:
    """One row: entries, distinct parties, current state and number of state changes."""
    totals = log.agg(
        F.count("*").alias("total_messages"),
        F.count_distinct(party).alias("parties"),
        F.max_by(state, F.struct(*order_by)).alias("current_state"),
    )
    return totals.withColumn("state_changes", F.lit(changes.count()))


def _record_errors() -> Column:
    """All schema errors of a parsed record (``_doc``, ``_keys``, ``_single``); missing fields stop the further checks."""
    field = lambda f: F.try_variant_get("_doc", f"$.{f}", "variant")
    kind = lambda f: F.coalesce(F.schema_of_variant(field(f)), F.lit("VOID"))
    value = lambda f: F.try_variant_get("_doc", f"$.{f}", "string")
    is_text = lambda f: kind(f) == "STRING"
    unless = lambda ok, message: F.when(~F.coalesce(ok, F.lit(False)), message)
    required = F.array(*[F.lit(f) for f in sorted(REQUIRED_FIELDS)])
    missing = F.array_except(required, F.coalesce("_keys", F.array().cast("array<string>")))
    stamp = value("timestamp")
    day = F.try_to_timestamp(F.substring(stamp, 1, 10), F.lit("yyyy-MM-dd"))
    checks = F.array_compact(
        F.array(
            unless(is_text("sender") & (F.length(value("sender")) > 0), F.lit(EMPTY_SENDER)),
            unless(is_text("recipient") & (F.length(value("recipient")) > 0), F.lit(EMPTY_RECIPIENT)),
            unless(
                is_text("message_type") & value("message_type").isin(*MESSAGE_TYPES),
                F.concat(F.lit(BAD_TYPE), F.coalesce(value("message_type"), F.lit("None"))),
            ),
            unless(
                is_text("priority") & value("priority").isin(*MESSAGE_PRIORITIES),
                F.concat(F.lit(BAD_PRIORITY), F.coalesce(value("priority"), F.lit("None"))),
            ),
            unless(F.startswith(kind("content"), F.lit("OBJECT")), F.lit(BAD_CONTENT)),
            unless(is_text("correlation_id"), F.lit(BAD_CORRELATION)),
            unless(
                is_text("timestamp") & stamp.rlike(ISO_TIMESTAMP) & day.isNotNull(),
                F.lit(BAD_TIMESTAMP),
            ),
        )
    )
    lost = F.array(F.concat(F.lit(MISSING_FIELDS), F.array_join(missing, ", ")))
    invalid = F.col("_doc").isNull() | F.col("_keys").isNull() | ~F.col("_single")
    return F.when(invalid, F.array(F.lit(INVALID_JSON))).when(F.size(missing) > 0, lost).otherwise(checks)


def validate_records(log: DataFrame, json: str) -> DataFrame:
    """Add ``errors`` and ``is_valid``; each record is parsed once before the checks.

    The parsed record is a generated row: a filter on the result would else be moved below the
    parsing, which it would repeat for each check.
    """
    once = F.struct(
        F.try_parse_json(json).alias("_doc"), F.json_object_keys(json).alias("_keys"), is_json_value(F.col(json)).alias("_single")
    )
    parsed = log.select("*", F.inline(F.array(once)))
    checked = parsed.withColumn("errors", _record_errors()).drop("_doc", "_keys", "_single")
    return checked.withColumn("is_valid", F.size("errors") == 0)


def decode_records(log: DataFrame, json: str) -> DataFrame:
    """Typed fields of valid records."""
    valid = validate_records(log, json).filter("is_valid").drop("errors", "is_valid")
    return valid.withColumn("record", F.from_json(json, RECORD_SCHEMA)).select("*", "record.*").drop("record")


def encode_records(records: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """JSON text of typed records in ``json``."""
    return records.withColumn("json", F.to_json(F.struct(*fields)))


def is_json_value(text: Column) -> Column:
    """Whether the text is exactly one JSON value.  The parsers stop after the first value, so
    the text must also hold as the only element of an array and as a member of an object."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    member = F.size(F.json_object_keys(F.concat(F.lit('{"value": '), text, F.lit("}")))) == 1
    return F.coalesce(alone & member, F.lit(False))


def embedded_json(text: Column, schema: str, default: Column, array: bool = False) -> Column:
    """JSON between the first opening and the last closing bracket, or the default when absent or broken."""
    pattern = r"(?s)\[.*\]" if array else r"(?s)\{.*\}"
    found = F.regexp_extract(text, pattern, 0)
    return F.when(is_json_value(found), F.from_json(found, schema)).otherwise(default)
