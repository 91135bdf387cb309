"""Sources, sinks, profiling, cleaning and validation queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import long_sql, register, table
from tabsight.catalog.tables import GAPPY_SQL, LINE_COLUMNS, gappy_events
from tabsight.functions.columns import rounded, select_numeric
from tabsight.operators import clean, keys, profile, stats, validate
from tabsight.operators.profile import DATE_PATTERNS, FALSE_TOKENS, TRUE_TOKENS
from tabsight.sources import csv, dictionary, results
from tabsight.sources.scratch import scratch_path


# ---------------------------------------------------------------- sources and sinks
@register(
    "csv_scan_na",
    """
    SELECT event_id,
           CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END AS event_type,
           CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value
    FROM events""",
)
def csv_scan_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    path = scratch_path(spark, "events-csv")
    table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "N/A").when(kind == "view", "-").otherwise(kind).alias("event_type"),
        F.when(kind == "signup", "?").otherwise(F.col("value").cast("string")).alias("value"),
    ).write.csv(path, header=True)
    scanned = csv.scan_csv(spark, path)
    return scanned.select(
        F.col("event_id").try_cast("bigint").alias("event_id"), "event_type", clean.coerce_numeric(F.col("value")).alias("value")
    )


@register(
    "csv_scan_text",
    """
    SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents
    UNION ALL SELECT -1, count(*), '' FROM documents""",
)
def csv_scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes and line breaks to CSV and back; row -1 is the preflight's record count."""
    path = scratch_path(spark, "texts-csv")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.csv(
        path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = csv.read_csv(spark, path).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))
    counted = csv.preflight(spark, path).agg(F.sum("data_rows").alias("chars"))
    return back.unionByName(counted.select(F.lit(-1).cast("bigint").alias("doc_id"), "chars", F.lit("").alias("digest")))


_LATIN = r"[\x00-\xff]*"  # French documents whose text Latin 1 can hold are written in it


def _latin_sql(text: str) -> str:
    return f"lang = 'fr' AND regexp_full_match({text}, '[\\x00-\\x{{ff}}]*', 's')"


def _encoded_texts(spark: SparkSession, sf_dir: str) -> list[str]:
    """Whole texts as CSV, one folder in ISO-8859-1 and one in UTF-8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    latin = (F.col("lang") == "fr") & F.col("text").rlike(f"(?s)^{_LATIN}$")
    paths = [scratch_path(spark, "latin-csv"), scratch_path(spark, "utf8-csv")]
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.filter(latin).write.csv(paths[0], encoding="ISO-8859-1", **options)
    docs.filter(~latin).write.csv(paths[1], **options)
    return paths


@register(
    "csv_encoding_census",
    f"""
    SELECT CASE WHEN {_latin_sql('text')} THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding,
           sum(1 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS rows
    FROM documents GROUP BY 1""",
)
def csv_encoding_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files by the encoding found in them, without the header lines."""
    census = csv.encoding_census(spark, _encoded_texts(spark, sf_dir))
    return census.groupBy("encoding").agg((F.sum("lines") - F.count("*")).alias("rows"))  # one header line per file


@register(
    "csv_encoding_fallback",
    """
    SELECT lang, count(*) AS rows, count(DISTINCT md5(text)) AS texts, sum(length(text))::BIGINT AS chars, min(md5(text)) AS least_digest
    FROM documents GROUP BY lang""",
)
def csv_encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = csv.read_csv(spark, _encoded_texts(spark, sf_dir))
    return back.groupBy("lang").agg(
        F.count("*").alias("rows"), F.count_distinct(F.md5("text")).alias("texts"), F.sum(F.length("text")).alias("chars"),
        F.min(F.md5("text")).alias("least_digest"))


@register(
    "csv_preflight",
    """
    SELECT 'missing' AS kind, 0::BIGINT AS columns, 0::BIGINT AS data_rows, 'File does not exist' AS errors, '' AS warnings
    UNION ALL
    SELECT 'narrow', 1, count(*), '', 'Only one column detected - check delimiter settings' FROM events
    UNION ALL
    SELECT 'wide', 4, count(*), '', '' FROM events""",
)
def csv_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    wide, narrow = scratch_path(spark, "wide"), scratch_path(spark, "narrow")
    events.select("event_id", "ts", "event_type", "value").write.csv(wide, header=True)
    events.select("event_id").write.csv(narrow, header=True)
    checked = csv.preflight(spark, [wide, narrow, scratch_path(spark, "missing")])
    kind = F.regexp_extract("file", r"/(wide|narrow|missing)-[0-9a-f]+", 1)
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), "; ")
    return checked.groupBy(kind.alias("kind")).agg(
        F.coalesce(F.max("columns"), F.lit(0)).alias("columns"),
        F.coalesce(F.sum("data_rows"), F.lit(0)).alias("data_rows"),
        F.regexp_extract(text("errors"), "^[^:]*", 0).alias("errors"),
        text("warnings").alias("warnings"),
    )


EVENT_DICTIONARY = json.dumps(
    {
        "columns": {
            "event_id": {"description": "row id", "is_nullable": False},
            "ts": {"data_type": "temporal", "is_nullable": False},
            "event_type": {"data_type": "categorical", "categorical_values": ["click", "view", "purchase"]},
            "value": {"data_type": "Numerical", "unit": "points", "valid_range": [1, 200], "is_nullable": False},
            "props": {"data_type": "blob", "is_nullable": False},
            "ghost": {"description": "not in the table"},
        },
        "primary_keys": ["event_id"],
    }
)


@register(
    "dictionary_columns",
    """
    WITH props AS (
      SELECT CASE WHEN count(props) > 0 AND count(DISTINCT props) <= 50 AND count(DISTINCT props)::DOUBLE / count(props) < 0.5
                  THEN 'CATEGORICAL' ELSE 'TEXT' END AS found FROM events)
    SELECT * FROM (VALUES
      ('event_id', 'NUMERICAL', 'row id', NULL, NULL, NULL, NULL, FALSE),
      ('ts', 'TEMPORAL', '', NULL, NULL, NULL, NULL, FALSE),
      ('event_type', 'CATEGORICAL', '', NULL, NULL, NULL, 'click,view,purchase', TRUE),
      ('value', 'NUMERICAL', '', 'points', 1.0::DOUBLE, 200.0::DOUBLE, NULL, FALSE),
      ('ghost', 'TEXT', 'not in the table', NULL, NULL, NULL, NULL, TRUE)
    ) AS t("column", data_type, description, unit, low, high, allowed, is_nullable)
    UNION ALL SELECT 'props', found, '', NULL, NULL, NULL, NULL, FALSE FROM props""",
)
def dictionary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = profile.detect_types(table(spark, sf_dir, "events"))
    rows = dictionary.parse_dictionary(spark, EVENT_DICTIONARY, detected)
    return rows.select(
        "column", "data_type", "description", "unit",
        F.get("valid_range", F.lit(0)).alias("low"), F.get("valid_range", F.lit(1)).alias("high"),
        F.array_join("categorical_values", ",").alias("allowed"), "is_nullable",
    )


@register("sample_head", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 1000")
def sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return profile.sample_head(events, ["event_id"])


_LINES = long_sql("lineitem", {c: c for c in LINE_COLUMNS}, "l_returnflag")


@register(
    "findings_roundtrip",
    f"""
    SELECT l_returnflag, "column", stat, value FROM (
      SELECT l_returnflag, "column", CAST(count(*) AS DOUBLE) AS n, round(avg(value), 6) AS mean, max(value) AS top
      FROM ({_LINES}) GROUP BY 1, 2)
    UNPIVOT (value FOR stat IN (n, mean, top))""",
)
def findings_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    wide = stats.scalar_stats(lines, LINE_COLUMNS, ("count", "mean", "max"), ["l_returnflag"]).select(
        "l_returnflag", "column", F.col("count").alias("n"), rounded("mean").alias("mean"), F.col("max").alias("top")
    )
    findings = stats.long_form(wide, ["l_returnflag", "column"], ["n", "mean", "top"])
    path = scratch_path(spark, "findings")
    results.write_results(findings, path, "json")
    return results.read_results(spark, path, findings.schema, "json")


# ---------------------------------------------------------------- profile
def _type_sql(expr: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in (*TRUE_TOKENS, *FALSE_TOKENS))
    dated = " OR ".join(f"regexp_matches({expr}, '{p}')" for p in DATE_PATTERNS)
    return (
        f"CASE WHEN count({expr}) = 0 THEN 'TEXT' "
        f"WHEN avg(CASE WHEN {dated} THEN 1.0 WHEN {expr} IS NOT NULL THEN 0.0 END) > 0.5 THEN 'TEMPORAL' "
        f"WHEN bool_and(lower({expr}) IN ({tokens})) AND count(DISTINCT lower({expr})) <= 2 THEN 'BOOLEAN' "
        f"WHEN count(DISTINCT {expr})::DOUBLE / count({expr}) < 0.5 AND count(DISTINCT {expr}) <= 50 THEN 'CATEGORICAL' "
        f"ELSE 'TEXT' END"
    )


_TYPED_SQL = """
SELECT event_type, props, strftime(ts, '%m/%d/%Y') AS day_text,
       CASE WHEN event_type = 'click' THEN 'Yes' WHEN event_type = 'error' THEN NULL ELSE 'no' END AS flag_text,
       CAST(NULL AS VARCHAR) AS empty_text
FROM events"""


@register(
    "detect_types",
    "SELECT 'event_id' AS \"column\", 'NUMERICAL' AS data_type UNION ALL SELECT 'value', 'NUMERICAL' "
    "UNION ALL SELECT 'ts', 'TEMPORAL' UNION ALL SELECT 'is_click', 'BOOLEAN' UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', {_type_sql(c)} FROM ({_TYPED_SQL})"
        for c in ("event_type", "props", "day_text", "flag_text", "empty_text")
    ),
)
def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    frame = table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", "value", "props",
        F.date_format("ts", "MM/dd/yyyy").alias("day_text"),
        F.when(kind == "click", "Yes").when(kind == "error", None).otherwise("no").alias("flag_text"),
        F.lit(None).cast("string").alias("empty_text"),
        (kind == "click").alias("is_click"),
    )
    return profile.detect_types(frame)


_MISSING_SQL = "SELECT \"column\", missing, percent FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
    f"round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS percent FROM ({GAPPY_SQL})"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
) + ")"


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = profile.missing_report(gappy_events(spark, sf_dir))
    return report.withColumn("percent", rounded("percent"))


@register("missing_report", _MISSING_SQL)
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir)


@register("missing_alerts", f"SELECT *, percent > 50 AS high FROM ({_MISSING_SQL}) WHERE missing > 0")
def missing_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_alerts(_missing(spark, sf_dir))


@register(
    "missing_top5",
    f"SELECT *, CAST((SELECT sum(missing) FROM ({_MISSING_SQL})) AS BIGINT) AS total_missing "
    f"FROM ({_MISSING_SQL}) ORDER BY missing DESC, \"column\" LIMIT 5",
)
def missing_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_top(_missing(spark, sf_dir))


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    width = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}
    parts = []
    for c, dtype in columns.items():
        size = f"count({c}) * {width[dtype]}" if dtype in width else f"coalesce(sum(strlen({c})), 0)"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, count(*) AS rows, count(*) - count({c}) AS missing, "
            f"count(DISTINCT {c}) AS \"distinct\", round(({size}) / 1048576.0::DOUBLE, 6) AS memory_mb FROM {source}"
        )
    return " UNION ALL ".join(parts)


_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@register("data_profile", _profile_sql("orders", _ORDER_TYPES))
def data_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.data_profile(table(spark, sf_dir, "orders")).withColumn("memory_mb", rounded("memory_mb"))


_DOC_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@register("data_profile_text", _profile_sql("documents", _DOC_TYPES))
def data_profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.data_profile(table(spark, sf_dir, "documents")).withColumn("memory_mb", rounded("memory_mb"))


@register(
    "dtype_histogram",
    f"SELECT dtype, count(*) AS columns FROM ({_profile_sql('orders', _ORDER_TYPES)}) GROUP BY dtype",
)
def dtype_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dtype_histogram(profile.data_profile(table(spark, sf_dir, "orders")))


# ---------------------------------------------------------------- projection and cleaning
@register(
    "numeric_projection",
    "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
)
def numeric_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_numeric(table(spark, sf_dir, "part"))


@register(
    "coerce_numeric",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events",
)
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "error", "12,5 units").when(kind == "view", F.concat(F.lit(" "), F.col("value"), F.lit(" ")))
    frame = table(spark, sf_dir, "events").select("event_id", text.otherwise(F.col("value").cast("string")).alias("text"))
    return frame.select("event_id", clean.coerce_numeric(F.col("text")).alias("value"))


@register(
    "coerce_temporal",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
                          WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                          ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed
    FROM events""",
)
def coerce_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    shape = lambda f: F.date_format("ts", f)
    text = (
        F.when(kind == "error", F.lit("31/31/2024")).when(kind == "signup", shape("yyyy-MM-dd HH:mm:ss"))
        .when(kind == "click", shape("yyyy-MM-dd")).when(kind == "view", shape("MM/dd/yyyy")).otherwise(shape("MM-dd-yyyy"))
    )
    parsed = clean.coerce_temporal(F.col("text"))
    frame = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return frame.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register(
    "coerce_temporal_iso",
    """
    SELECT event_id, strftime(CASE event_type WHEN 'click' THEN date_trunc('second', ts) WHEN 'view' THEN ts - INTERVAL 2 HOUR
                                              WHEN 'purchase' THEN ts + INTERVAL 330 MINUTE WHEN 'signup' THEN date_trunc('minute', ts)
                                              ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') AS parsed
    FROM events""",
)
def coerce_temporal_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds with Z, fractions with offsets, minutes only, fractions alone."""
    kind = F.col("event_type")
    shape = lambda f: F.date_format("ts", f)
    full = shape("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(kind == "click", shape("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == "view", F.concat(full, F.lit("+02:00")))
        .when(kind == "purchase", F.concat(shape("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-0530"))).when(kind == "signup", shape("yyyy-MM-dd HH:mm"))
        .otherwise(full)
    )
    frame = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return frame.select("event_id", F.date_format(clean.coerce_temporal(F.col("text")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@register(
    "coerce_boolean",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'false' WHEN 'purchase' THEN 'true'
                                     WHEN 'signup' THEN 'false' END AS flag FROM events""",
)
def coerce_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    token = F.when(kind == "click", "YES").when(kind == "view", "f").when(kind == "purchase", "1").when(kind == "signup", "No")
    frame = table(spark, sf_dir, "events").select("event_id", token.otherwise("maybe").alias("token"))
    return frame.select("event_id", clean.coerce_boolean(F.col("token")).cast("string").alias("flag"))


@register(
    "coerce_categorical",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS event_type FROM events",
)
def coerce_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.coerce_categorical(F.col("event_type"), ["click", "view"])
    return table(spark, sf_dir, "events").select("event_id", kept.alias("event_type"))


@register(
    "general_normalize",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS padded,
           CAST(user_id AS DOUBLE) AS digits,
           CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS mixed
    FROM events""",
)
def general_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    frame = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "   ").otherwise(F.concat(F.lit("  "), kind, F.lit(" "))).alias("padded"),
        F.concat(user, F.lit(" ")).alias("digits"),
        F.when(kind == "view", "n/a").otherwise(user).alias("mixed"),
    )
    return clean.general_normalize(frame)


@register(
    "normalize_table",
    """
    SELECT event_id,
           CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS event_type,
           CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
           CAST(user_id AS DOUBLE) AS user_text
    FROM events""",
)
def normalize_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rules = dictionary.rules_of(dictionary.parse_dictionary(spark, EVENT_DICTIONARY, profile.detect_types(events)))
    frame = events.select(
        "event_id", "event_type",
        F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string")).alias("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.concat(F.lit(" "), F.col("user_id")).alias("user_text"),
    )
    cleaned = clean.normalize(frame, {c: r for c, r in rules.items() if c != "event_id"})
    return cleaned.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


# ---------------------------------------------------------------- validation
def _event_rules(spark: SparkSession, sf_dir: str):
    listed = dictionary.parse_dictionary(spark, EVENT_DICTIONARY, profile.detect_types(table(spark, sf_dir, "events")))
    return listed, dictionary.rules_of(listed)


_COLUMNS_SQL = """
SELECT 'error' AS severity, 'missing_column' AS rule, 'ghost' AS "column", 1::BIGINT AS n
UNION ALL SELECT 'warning', 'extra_column', column_name, 1 FROM (
  SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name)
WHERE column_name NOT IN ('event_id', 'ts', 'event_type', 'value', 'props', 'ghost')"""
_NULLS_SQL = " UNION ALL ".join(
    f"SELECT 'error' AS severity, 'nullability' AS rule, '{c}' AS \"column\", n FROM "
    f"(SELECT count(*) - count({c}) AS n FROM ({GAPPY_SQL})) WHERE n > 0"
    for c in ("event_id", "ts", "value", "props")
)
_RANGE_SQL = f"""
SELECT 'warning' AS severity, 'range' AS rule, 'value' AS "column", n FROM
(SELECT count(*) FILTER (WHERE value < 1 OR value > 200) AS n FROM ({GAPPY_SQL})) WHERE n > 0"""
_DOMAIN_VALUES_SQL = f"""
SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM ({GAPPY_SQL})
WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type"""
_DOMAIN_SQL = f"""
SELECT 'warning' AS severity, 'domain' AS rule, "column", count(*) AS n FROM ({_DOMAIN_VALUES_SQL}) GROUP BY "column\""""
_ISSUES_SQL = " UNION ALL ".join([_COLUMNS_SQL, _NULLS_SQL, _RANGE_SQL, _DOMAIN_SQL])


@register("validate_columns", _COLUMNS_SQL)
def validate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, _ = _event_rules(spark, sf_dir)
    return validate.check_columns(gappy_events(spark, sf_dir), listed)


@register("validate_nullability", _NULLS_SQL)
def validate_nullability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_nullability(gappy_events(spark, sf_dir), _event_rules(spark, sf_dir)[1])


@register("validate_range", _RANGE_SQL)
def validate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_range(gappy_events(spark, sf_dir), _event_rules(spark, sf_dir)[1])


@register("validate_domain", _DOMAIN_VALUES_SQL)
def validate_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.invalid_values(gappy_events(spark, sf_dir), _event_rules(spark, sf_dir)[1])


@register("validation_issues", _ISSUES_SQL)
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(gappy_events(spark, sf_dir), *_event_rules(spark, sf_dir))


@register(
    "validation_verdict",
    f"""
    SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid, count(*) FILTER (WHERE severity = 'error') AS errors,
           count(*) FILTER (WHERE severity = 'warning') AS warnings FROM ({_ISSUES_SQL})""",
)
def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.verdict(validate.validate(gappy_events(spark, sf_dir), *_event_rules(spark, sf_dir)))


# ---------------------------------------------------------------- keys
# every seventh order and some suppliers are taken out of the referenced tables; some line items have no supplier
_LINE_KEYS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem"""
_ORDERS_LEFT_SQL = "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0"
_PAIRS_LEFT_SQL = "SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_linenumber <= 2"
LINE_DICTIONARY = json.dumps(
    {
        "columns": {c: {"data_type": "numerical"} for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")},
        "primary_keys": ["l_orderkey", "l_suppkey"],
        "foreign_keys": [
            {"columns": ["l_orderkey"], "table": "orders", "references": ["o_orderkey"]},
            {"columns": ["l_partkey", "l_suppkey"], "table": "pairs", "references": ["part", "supplier"]},
            {"columns": ["l_partkey"], "table": "nowhere", "references": ["p_partkey"]},
        ],
    }
)


def _line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.when(F.col("l_linenumber") != 6, F.col("l_suppkey")).alias("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", supplier)


def _referenced(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    return {
        "orders": table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select("o_orderkey"),
        "pairs": lines.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")),
    }


_PK_SQL = f"""
SELECT l_orderkey, l_suppkey, count(*) AS n FROM ({_LINE_KEYS_SQL}) WHERE l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL
GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1"""
_FK_SQL = f"""
SELECT l_partkey, l_suppkey, count(*) AS n FROM ({_LINE_KEYS_SQL}) l
WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_PAIRS_LEFT_SQL}) p WHERE p.part = l.l_partkey AND p.supplier = l.l_suppkey)
GROUP BY l_partkey, l_suppkey"""
_FK_ORDERS_SQL = f"""
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN ({_ORDERS_LEFT_SQL}) GROUP BY l_orderkey"""
_KEY_ISSUES_SQL = f"""
SELECT 'error' AS severity, 'primary_key' AS rule, 'l_orderkey, l_suppkey' AS "column", sum(n)::BIGINT AS n FROM ({_PK_SQL}) HAVING sum(n) > 0
UNION ALL SELECT 'error', 'primary_key_null', 'l_orderkey, l_suppkey', count(*) FROM ({_LINE_KEYS_SQL}) WHERE l_suppkey IS NULL HAVING count(*) > 0
UNION ALL SELECT 'error', 'foreign_key', 'l_orderkey', sum(n)::BIGINT FROM ({_FK_ORDERS_SQL}) HAVING sum(n) > 0
UNION ALL SELECT 'error', 'foreign_key', 'l_partkey, l_suppkey', sum(n)::BIGINT FROM ({_FK_SQL}) HAVING sum(n) > 0
UNION ALL SELECT 'warning', 'referenced_table_missing', 'l_partkey', 1"""


@register("pk_duplicates", _PK_SQL)
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pk_duplicates(_line_keys(spark, sf_dir), dictionary.keys_of(spark, LINE_DICTIONARY).primary)


@register("fk_orphans", _FK_SQL)
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = dictionary.keys_of(spark, LINE_DICTIONARY).foreign[1]
    return keys.fk_orphans(_line_keys(spark, sf_dir), key.columns, _referenced(spark, sf_dir)[key.table], key.references)


@register("key_issues", _KEY_ISSUES_SQL)
def key_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.check_keys(_line_keys(spark, sf_dir), dictionary.keys_of(spark, LINE_DICTIONARY), _referenced(spark, sf_dir))


@register(
    "validation_verdict_keys",
    f"""
    SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid, count(*) FILTER (WHERE severity = 'error') AS errors,
           count(*) FILTER (WHERE severity = 'warning') AS warnings FROM ({_KEY_ISSUES_SQL})""",
)
def validation_verdict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over all rules, keys included; every column is in the dictionary and in order."""
    listed = dictionary.parse_dictionary(spark, LINE_DICTIONARY)
    found = validate.validate(
        _line_keys(spark, sf_dir), listed, dictionary.rules_of(listed), dictionary.keys_of(spark, LINE_DICTIONARY), _referenced(spark, sf_dir))
    return validate.verdict(found)
