"""Queries answered from stored profile states in place of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import long_sql, register, table
from tabsight.catalog.tables import LINE_COLUMNS
from tabsight.functions.columns import rounded
from tabsight.operators import summaries
from tabsight.sources.scratch import materialize, scratch_path

_MOMENTS = """count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, max(value) AS max,
           round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis"""


def _moments(described: DataFrame, keys: list[str]) -> DataFrame:
    digits = {"mean": 6, "std": 5, "skewness": 4, "kurtosis": 4}
    return described.select(
        *keys, "column", "count", *[rounded(s, digits[s]).alias(s) if s in digits else F.col(s) for s in ("mean", "std", "min", "max", "skewness", "kurtosis")]
    )


@register(
    "profile_states_merged",
    f"""SELECT "column", {_MOMENTS} FROM ({long_sql('lineitem', {c: c for c in LINE_COLUMNS})}) GROUP BY "column\"""",
)
def profile_states_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of rows after the other is profiled and stored; the whole is described from what was stored."""
    lines = table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "profile")
    late = F.coalesce(F.col("l_linenumber") > 3, F.lit(False))
    for batch, chosen in (("early", ~late), ("late", late)):
        summaries.store(summaries.summarize(lines.filter(chosen), LINE_COLUMNS, ["l_returnflag"], pairs=False), path, batch)
    return _moments(summaries.describe_state(summaries.stored(spark, path)), [])


@register(
    "profile_states_by_part",
    f"""SELECT l_returnflag, "column", {_MOMENTS}
    FROM ({long_sql('lineitem', {c: c for c in LINE_COLUMNS}, 'l_returnflag')}) GROUP BY l_returnflag, "column\"""",
)
def profile_states_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = summaries.summarize(table(spark, sf_dir, "lineitem"), LINE_COLUMNS, ["l_returnflag", "l_linestatus", "l_linenumber"], pairs=False)
    coarse = materialize(summaries.merge(materialize(fine, "profile"), ["l_returnflag"]), "profile")
    return _moments(summaries.describe_state(coarse, ["l_returnflag"]), ["l_returnflag"])


_GAPS = """(SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
                CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS user_id, event_id FROM events)"""


def _pair_sql(a: str, b: str) -> str:
    both = f"FROM {_GAPS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return f"""SELECT '{a}' AS "column", '{b}' AS other, count(*) AS n, round(corr({a}, {b}), 6) AS pearson {both}"""


@register("profile_states_corr", " UNION ALL ".join(_pair_sql(*p) for p in (("value", "user_id"), ("value", "event_id"), ("user_id", "event_id"))))
def profile_states_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with gaps from the merged states of the days' rows."""
    kind = F.col("event_type")
    gaps = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), F.when(kind != "error", F.col("value")).alias("value"),
        F.when(kind != "view", F.col("user_id")).alias("user_id"), "event_id",
    )
    days = materialize(summaries.summarize(gaps, ["value", "user_id", "event_id"], ["day"]), "profile")
    return summaries.correlate_state(summaries.merge(days)).withColumn("pearson", rounded("pearson"))
