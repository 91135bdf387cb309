"""Findings, recommendations, ranking and whole runs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import SQL, long_sql, register, table
from tabsight.catalog.series import _DAILY, all_events, trend_sql
from tabsight.catalog.statistics import (
    ALL_FLAGS_SQL, SUMMARY_SQL, _GAP_COLUMNS, _kendall_sql, _pairs_sql, _pearson_one, _spearman_one, outlier_summary,
    threshold_flags,
)
from tabsight.catalog.tables import (
    AMOUNTS, AMOUNTS_SQL, ENTITY_SQL, LINE_COLUMNS, amounts, daily_orders, entities,
)
from tabsight.functions.columns import rounded
from tabsight.operators import correlation, ranking, rules, stats
from tabsight.operators import timeseries as ts
from tabsight.plans import analyses, decisions, workflow
from tabsight.sources.scratch import scratch_path

# ---------------------------------------------------------------- sources of the rules
_PAIRS_SQL = _pairs_sql(f"({AMOUNTS_SQL})", AMOUNTS, _pearson_one)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.correlations(amounts(spark, sf_dir), methods=["pearson"])
    return found.withColumn("corr", rounded("corr"))


# event_id rises with time, what is left of it falls, value does neither
_TREND_COLUMNS = {"event_id": "event_id", "remaining": "-event_id", "value": "value"}
_TRENDS_SQL = " UNION ALL ".join(
    "SELECT '{c}' AS \"column\", trend_direction, trend_strength FROM ({t})".format(
        c=c,
        t=trend_sql(f"(SELECT {e} AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS x FROM events)", ""),
    )
    for c, e in _TREND_COLUMNS.items()
)


def _trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("remaining", -F.col("event_id"))
    found = analyses.trends(events, list(_TREND_COLUMNS), "ts", ["event_id"])
    return found.select("column", "trend_direction", rounded("trend_strength").alias("trend_strength"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_summary(spark, sf_dir).withColumn("percent", rounded("percent"))


_SUPPLIER_STATS_SQL = f"""
SELECT l_suppkey, "column", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM ({long_sql('lineitem', {c: c for c in LINE_COLUMNS}, 'l_suppkey')}) GROUP BY 1, 2"""


def _supplier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stats.scalar_stats(table(spark, sf_dir, "lineitem"), LINE_COLUMNS, ("mean", "std"), ["l_suppkey"])
    return wide.select("l_suppkey", "column", rounded("mean").alias("mean"), rounded("std").alias("std"))


# ---------------------------------------------------------------- rules
@register(
    "insights",
    f"""
    SELECT 'anomaly' AS kind, "column" AS subject, method AS detail, percent AS value FROM ({SUMMARY_SQL}) WHERE count > 0
    UNION ALL SELECT 'correlation', col1 || ' - ' || col2, method, corr FROM ({_PAIRS_SQL}) WHERE abs(corr) > 0.7
    UNION ALL SELECT 'trend', "column", trend_direction, trend_strength FROM ({_TRENDS_SQL}) WHERE trend_strength > 0.5""",
)
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.insights(_summary(spark, sf_dir), _pairs(spark, sf_dir), _trends(spark, sf_dir))


def _id(rule: str, *parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join([f"'{rule}'", *parts]) + "))"


_REC = ("id", "rule", "subject", "detail", "title", "rule_priority", "estimated_impact", "resources", "timeline", "rule_risk")

_REC_OUTLIER_SQL = f"""
SELECT {_id('outlier', '"column"', 'method')} AS id, 'outlier' AS rule, "column" AS subject, method AS detail,
       'Investigate ' || "column" || ' Anomalies' AS title,
       CASE WHEN percent > 20 THEN 'HIGH' WHEN percent > 10 THEN 'MEDIUM' ELSE 'LOW' END AS rule_priority,
       round(percent / 100, 8) AS estimated_impact, 'Data analyst; Domain expert' AS resources,
       CASE WHEN percent > 20 THEN '1-2 weeks' WHEN percent > 10 THEN '2-4 weeks' ELSE '1-2 months' END AS timeline,
       'MEDIUM' AS rule_risk
FROM ({SUMMARY_SQL}) WHERE percent > 5"""
_REC_CORR_SQL = f"""
SELECT {_id('correlation', "col1 || ' - ' || col2", 'method')} AS id, 'correlation' AS rule, col1 || ' - ' || col2 AS subject,
       method AS detail,
       'Leverage ' || CASE WHEN corr > 0 THEN 'Positive' ELSE 'Negative' END || ' Correlation: ' || col1 || ' - ' || col2 AS title,
       'MEDIUM' AS rule_priority, abs(corr) AS estimated_impact, 'Data scientist; Process engineer' AS resources,
       '2-6 weeks' AS timeline, 'LOW' AS rule_risk
FROM ({_PAIRS_SQL}) WHERE abs(corr) > 0.8"""
_REC_TREND_SQL = f"""
SELECT {_id('trend', '"column"', 'trend_direction')} AS id, 'trend' AS rule, "column" AS subject, trend_direction AS detail,
       CASE WHEN trend_direction = 'decreasing' THEN 'Address declining performance' ELSE 'Optimize improving performance' END
         || ': ' || "column" AS title,
       CASE WHEN trend_direction = 'decreasing' THEN 'HIGH' ELSE 'MEDIUM' END AS rule_priority, trend_strength AS estimated_impact,
       'Maintenance team; Equipment specialist' AS resources,
       CASE WHEN trend_direction = 'decreasing' THEN '1-3 weeks' ELSE '1-2 months' END AS timeline,
       CASE WHEN trend_direction = 'decreasing' THEN 'HIGH' ELSE 'LOW' END AS rule_risk
FROM ({_TRENDS_SQL}) WHERE trend_strength > 0.7"""
_REC_CV_SQL = f"""
SELECT {_id('variability', 'CAST(l_suppkey AS VARCHAR)', '"column"', "'cv'")} AS id, 'variability' AS rule, "column" AS subject,
       'cv' AS detail, 'Reduce Variability in ' || "column" AS title, 'MEDIUM' AS rule_priority,
       round(least(cv, 1.0), 8) AS estimated_impact, 'Process engineer; Quality control' AS resources,
       '3-6 weeks' AS timeline, 'MEDIUM' AS rule_risk
FROM (SELECT *, CASE WHEN mean = 0 THEN 0 ELSE std / mean END AS cv FROM ({_SUPPLIER_STATS_SQL})) WHERE cv > 0.5"""


def _flat(recs: DataFrame) -> DataFrame:
    """Arrays as text, for comparison."""
    joined = recs.withColumn("resources", F.array_join("required_resources", "; "))
    return joined.withColumn("estimated_impact", rounded("estimated_impact", 8)).select(*_REC)


@register("rec_outlier", _REC_OUTLIER_SQL)
def rec_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rules.outlier_recommendations(_summary(spark, sf_dir)))


@register("rec_correlation", _REC_CORR_SQL)
def rec_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rules.correlation_recommendations(_pairs(spark, sf_dir)))


@register("rec_trend", _REC_TREND_SQL)
def rec_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rules.trend_recommendations(_trends(spark, sf_dir)))


def _cv_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.variability_recommendations(_supplier_stats(spark, sf_dir), ["l_suppkey"]).withColumn(
        "estimated_impact", rounded("estimated_impact", 8)
    )


@register("rec_variability", _REC_CV_SQL)
def rec_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_cv_recs(spark, sf_dir))


@register(
    "rec_texts",
    f"""
    SELECT {_id('variability', 'CAST(l_suppkey AS VARCHAR)', '"column"', "'cv'")} AS id,
           printf('High variability detected in ''%s'' (CV: %.3f). This indicates inconsistent performance that may benefit from standardization or process improvement.', "column", std / mean) AS description,
           printf('Coefficient of variation: %.3f | Standard deviation: %.3f | Mean value: %.3f', std / mean, std, mean) AS evidence
    FROM ({_SUPPLIER_STATS_SQL}) WHERE mean <> 0 AND std / mean > 0.5""",
)
def rec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _cv_recs(spark, sf_dir)
    return recs.select("id", "description", F.array_join("supporting_evidence", " | ").alias("evidence"))


ALL_RECS_SQL = " UNION ALL ".join([_REC_OUTLIER_SQL, _REC_CORR_SQL, _REC_TREND_SQL, _REC_CV_SQL])


def all_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        rules.outlier_recommendations(_summary(spark, sf_dir)),
        rules.correlation_recommendations(_pairs(spark, sf_dir)),
        rules.trend_recommendations(_trends(spark, sf_dir)),
        _cv_recs(spark, sf_dir).drop("l_suppkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("estimated_impact", rounded("estimated_impact", 8))


def _score_sql() -> str:
    risk = " ".join(f"WHEN rule_risk = '{k}' THEN {v}::DOUBLE" for k, v in rules.RISK_WEIGHTS.items())
    when = " ".join(f"WHEN contains(lower(timeline), '{k}') THEN {v}::DOUBLE" for k, v in rules.TIMELINE_SCORES)
    return (
        f"least(1.0::DOUBLE, estimated_impact * 0.2::DOUBLE + (CASE {risk} ELSE 0.5::DOUBLE END) * 0.4::DOUBLE + "
        f"(CASE {when} ELSE 0.5::DOUBLE END) * 0.3::DOUBLE + greatest(0.1::DOUBLE, 1.0::DOUBLE - 2 * 0.1::DOUBLE) * 0.1::DOUBLE)"
    )


PRIORITY_SQL = f"""
SELECT id, rule, subject, rule_priority, round(score, 6) AS priority_score, rank,
       CASE WHEN rank - 1 < n * 0.2::DOUBLE THEN 'HIGH' WHEN rank - 1 < n * 0.6::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS final_priority,
       estimated_impact, timeline
FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, count(*) OVER () AS n
      FROM (SELECT *, {_score_sql()} AS score FROM ({ALL_RECS_SQL})))"""


@register(
    "priority_rank",
    f"SELECT id, rule, subject, rule_priority, priority_score, rank, final_priority FROM ({PRIORITY_SQL})",
)
def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rules.prioritize(all_recommendations(spark, sf_dir))
    return ranked.select(
        "id", "rule", "subject", "rule_priority", rounded("priority_score").alias("priority_score"), "rank", "final_priority"
    )


_RISK_SQL = f"""
SELECT *, CASE WHEN round(risk_score, 12) >= 0.8 THEN 'CRITICAL' WHEN round(risk_score, 12) >= 0.6 THEN 'HIGH'
               WHEN round(risk_score, 12) >= 0.4 THEN 'MEDIUM' WHEN round(risk_score, 12) >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS final_risk
FROM (SELECT *, least(1.0::DOUBLE, estimated_impact * 0.4::DOUBLE + (CASE WHEN contains(lower(timeline), 'immediate') THEN 0.9::DOUBLE
        WHEN contains(lower(timeline), 'week') THEN 0.6::DOUBLE WHEN contains(lower(timeline), 'month') THEN 0.3::DOUBLE
        ELSE 0.5::DOUBLE END) * 0.3::DOUBLE + 2 * 0.15::DOUBLE * 0.3::DOUBLE) AS risk_score FROM ({PRIORITY_SQL}))"""


@register("risk_level", f"SELECT id, rule, subject, round(risk_score, 6) AS risk_score, final_risk FROM ({_RISK_SQL})")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = rules.assess_risk(all_recommendations(spark, sf_dir))
    return assessed.select("id", "rule", "subject", rounded("risk_score").alias("risk_score"), "final_risk")


@register(
    "risk_distribution",
    f"""
    WITH r AS ({_RISK_SQL})
    SELECT l.severity, l.level, count(r.id) AS recommendations, (SELECT round(avg(risk_score), 6) FROM r) AS overall_risk_score
    FROM (VALUES (0::BIGINT, 'CRITICAL'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW'), (4, 'MINIMAL')) l(severity, level)
    LEFT JOIN r ON r.final_risk = l.level GROUP BY 1, 2""",
)
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = rules.risk_distribution(rules.assess_risk(all_recommendations(spark, sf_dir)))
    return spread.withColumn("overall_risk_score", rounded("overall_risk_score"))


@register(
    "high_risk", f"SELECT id, title_subject AS subject, final_risk FROM (SELECT id, subject AS title_subject, final_risk FROM ({_RISK_SQL})) WHERE final_risk IN ('CRITICAL', 'HIGH')"
)
def high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.high_risk(rules.assess_risk(all_recommendations(spark, sf_dir))).select("id", "subject", "final_risk")


_ACTIONS_SQL = ", ".join(
    f"('{level}', {i}::BIGINT, '{action}')"
    for level, actions in rules.MITIGATIONS.items()
    for i, action in enumerate((*actions, *rules.GENERAL_MITIGATIONS), 1)
)


@register(
    "mitigations",
    f"""
    SELECT r.id, r.final_risk, a.step, a.action FROM ({_RISK_SQL}) r
    JOIN (VALUES {_ACTIONS_SQL}) a(final_risk, step, action) ON r.final_risk = a.final_risk""",
)
def mitigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mitigations(rules.assess_risk(all_recommendations(spark, sf_dir))).select("id", "final_risk", "step", "action")


@register(
    "decision_summary",
    f"""
    SELECT count(*) AS total_recommendations, count(*) FILTER (WHERE final_priority = 'HIGH') AS high_priority_count,
           count(*) FILTER (WHERE final_risk IN ('CRITICAL', 'HIGH')) AS high_risk_count FROM ({_RISK_SQL})""",
)
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decision_summary(decisions.decide(all_recommendations(spark, sf_dir)))


@register(
    "recs_by_priority",
    f"""
    SELECT final_priority, id, subject, row_number() OVER (PARTITION BY final_priority ORDER BY rank, id) AS number
    FROM ({PRIORITY_SQL})""",
)
def recs_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = rules.by_priority(rules.prioritize(all_recommendations(spark, sf_dir)))
    return numbered.select("final_priority", "id", "subject", "number")


@register(
    "key_findings",
    f"""
    SELECT section, item, finding FROM (
      SELECT 1 AS section, '' AS item, printf('Detected %d anomalous data points requiring investigation', n) AS finding
      FROM (SELECT count(*) AS n FROM ({ALL_FLAGS_SQL})) WHERE n > 0
      UNION ALL SELECT 2, '', printf('Identified %d strong correlations between variables', n)
      FROM (SELECT count(*) AS n FROM ({_PAIRS_SQL}) WHERE abs(corr) > 0.7) WHERE n > 0
      UNION ALL SELECT 3, "column", "column" || ' shows ' || trend_direction || ' trend over time' FROM ({_TRENDS_SQL})
      UNION ALL SELECT 4, '', printf('%d high-priority maintenance actions recommended', n)
      FROM (SELECT count(*) AS n FROM ({PRIORITY_SQL}) WHERE final_priority = 'HIGH') WHERE n > 0)
    ORDER BY section, item LIMIT 10""",
)
def key_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = threshold_flags(spark, sf_dir).agg(F.count("*").alias("total"))
    ranked = rules.prioritize(all_recommendations(spark, sf_dir))
    return rules.key_findings(total, _pairs(spark, sf_dir), _trends(spark, sf_dir), ranked, limit=10)


# ---------------------------------------------------------------- scenarios and ranking
def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    return entities(spark, sf_dir).select(
        "part",
        pair(price=F.col("discount_use"), volume=F.col("tax_use"), unknown=F.col("days")).alias("parameters"),
        pair(price=F.col("price_level"), volume=F.col("volume_level")).alias("expected_outcomes"),
        pair(price=F.col("price_level"), volume=F.col("volume_level")).alias("predicted_outcomes"),
        pair(budget=F.col("discount_use"), time=F.col("tax_use")).alias("resource_utilization"),
        F.when(F.col("return_share") > 0, pair(overall_risk=F.col("return_share")))
        .otherwise(pair(technical_risk=F.lit(0.1))).alias("risk_assessment"),
        pair(implementation_days=F.col("days")).alias("timeline_impact"),
    )


@register(
    "whatif_projection",
    f"""
    SELECT part, parameter, round(p, 6) AS predicted, round(p * 0.8, 6) AS low, round(p * 1.2, 6) AS high FROM (
      SELECT part, 'price' AS parameter, price_level * (1 + discount_use * 0.1) AS p FROM ({ENTITY_SQL})
      UNION ALL SELECT part, 'volume', volume_level * (1 + tax_use * 0.1) FROM ({ENTITY_SQL})
      UNION ALL SELECT part, 'unknown', 0.0 FROM ({ENTITY_SQL}))""",
)
def whatif_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = ranking.whatif_projection(_scenarios(spark, sf_dir), ["part"])
    return projected.select("part", "parameter", *[rounded(c).alias(c) for c in ("predicted", "low", "high")])


SCORES_SQL = f"""
SELECT part, round((price_level + volume_level) / 2 / greatest((discount_use + tax_use) / 2, 0.1), 9) AS cost_effectiveness,
       round(1.0::DOUBLE - CASE WHEN return_share > 0 THEN return_share ELSE 0.5 END, 9) AS risk_reduction,
       round(1.0::DOUBLE - days / 365.0::DOUBLE, 9) AS timeline_efficiency,
       round(1.0::DOUBLE - abs((discount_use + tax_use) / 2 - 0.7::DOUBLE), 9) AS resource_utilization
FROM ({ENTITY_SQL})"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ranking.criterion_scores(_scenarios(spark, sf_dir), ["part"])
    return scores.select("part", *[rounded(c, 9).alias(c) for c in ranking.CRITERIA])


@register("criterion_scores", SCORES_SQL)
def criterion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


RANKS_SQL = f"""
SELECT criterion, part, score, row_number() OVER (PARTITION BY criterion ORDER BY score DESC, part) AS rank,
       count(*) OVER (PARTITION BY criterion) AS n
FROM (SELECT * FROM ({SCORES_SQL}) UNPIVOT (score FOR criterion IN ({', '.join(ranking.CRITERIA)})))"""


@register("criterion_rank", RANKS_SQL)
def criterion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.criterion_rank(_scores(spark, sf_dir), "part").select("criterion", "part", "score", "rank", "n")


_AT_LEAST = " AND ".join(f"b.{c} >= a.{c}" for c in ranking.CRITERIA)
_BETTER = " OR ".join(f"b.{c} > a.{c}" for c in ranking.CRITERIA)


@register(
    "pareto_front",
    f"""
    WITH s AS ({SCORES_SQL})
    SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {_AT_LEAST} AND ({_BETTER}))""",
)
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pareto_front(_scores(spark, sf_dir), "part")


@register(
    "pareto_split",
    f"""
    WITH s AS ({SCORES_SQL})
    SELECT part, NOT EXISTS (SELECT 1 FROM s b WHERE {_AT_LEAST} AND ({_BETTER})) AS pareto_efficient FROM s a""",
)
def pareto_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dominance_split(_scores(spark, sf_dir), "part")


@register(
    "best_overall",
    f"""
    SELECT part, average_score FROM (SELECT part, avg(CAST(n - rank + 1 AS DOUBLE)) AS average_score FROM ({RANKS_SQL}) GROUP BY part)
    ORDER BY average_score DESC, part LIMIT 1""",
)
def best_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_overall(ranking.criterion_rank(_scores(spark, sf_dir), "part"), "part")


@register("best_per_criterion", f"SELECT criterion, part, score FROM ({RANKS_SQL}) WHERE rank = 1")
def best_per_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_per_criterion(ranking.criterion_rank(_scores(spark, sf_dir), "part"), "part")


# ---------------------------------------------------------------- runs
_EVENT_COLUMNS = ("value", "user_id")
_DESCRIPTIVE_SQL = """
SELECT 'descriptive' AS analysis, "column" AS item, stat, round(value, 4) AS value FROM (
  SELECT c."column", CAST(count(*) AS DOUBLE) AS count, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
         var_samp(value) AS var, min(value) AS min, max(value) AS max, skewness(value) AS skewness, kurtosis(value) AS kurtosis,
         quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75,
         quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, any_value(mode) AS mode,
         CAST(any_value(mode_count) AS DOUBLE) AS mode_count
  FROM ({cells}) c JOIN (
    SELECT "column", value AS mode, n AS mode_count FROM (
      SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rn
      FROM ({cells}) GROUP BY 1, 2) WHERE rn = 1) m ON c."column" = m."column" GROUP BY 1)
UNPIVOT (value FOR stat IN (count, mean, median, std, var, min, max, skewness, kurtosis, q25, q75, iqr, mode, mode_count))"""


def _descriptive_sql(source: str, columns) -> str:
    return _DESCRIPTIVE_SQL.replace("{cells}", long_sql(source, {c: c for c in columns}))


def _corr_items(pairs: str) -> str:
    return (
        f"SELECT 'correlation' AS analysis, method || ' | ' || col1 || ' | ' || col2 AS item, 'corr' AS stat, "
        f"round(corr, 4) AS value FROM ({pairs})"
    )


@register(
    "targeted_run",
    _descriptive_sql("lineitem", LINE_COLUMNS)
    + " UNION ALL "
    + _corr_items(_pairs_sql("lineitem", ("l_quantity", "l_discount"), _pearson_one)),
)
def targeted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = [
        {"type": "descriptive", "columns": list(LINE_COLUMNS)},
        {"type": "correlation", "columns": ["l_quantity", "l_discount"], "methods": ["pearson"]},
        {"type": "unheard of"},
    ]
    results = analyses.analyze(table(spark, sf_dir, "lineitem"), ["l_orderkey"], plan)
    return analyses.unite(results).withColumn("value", rounded("value", 4))


_FULL_OUTLIERS_SQL = " UNION ALL ".join(
    f"""SELECT 'outliers' AS analysis, '{m} | value' AS item, unnest(['count', 'percent']) AS stat,
        unnest([CAST(c AS DOUBLE), round(c * 100.0::DOUBLE / n, 4)]) AS value FROM (
        SELECT count(*) FILTER (WHERE {test}) AS c, count(*) AS n FROM events,
        (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_pop(value) AS std FROM events))"""
    for m, test in (
        ("iqr", "value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"),
        ("zscore", "abs((value - mean) / std) > 3.0"),
    )
)
_FULL_AGG_SQL = f"""
SELECT 'aggregation' AS analysis, "column" AS item, stat, round(value, 4) AS value FROM (
  SELECT "column", sum(value) AS sum, CAST(count(*) AS DOUBLE) AS count, avg(value) AS mean, stddev_samp(value) AS std,
         min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
         quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.95) AS q95, median(value) AS median
  FROM ({long_sql('events', {'value': 'value'})}) GROUP BY 1)
UNPIVOT (value FOR stat IN (sum, count, mean, std, min, max, q25, q50, q75, q90, q95, median))"""
_FULL_TREND_SQL = f"""
SELECT 'timeseries.trend' AS analysis, 'value | ' || trend_direction AS item, stat, round(value, 4) AS value FROM (
  SELECT trend_direction, slope, intercept, r_squared, std_error, trend_strength FROM (
  {trend_sql('(SELECT value AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS x FROM events)', '')}))
UNPIVOT (value FOR stat IN (slope, intercept, r_squared, std_error, trend_strength))"""


@register(
    "full_run",
    " UNION ALL ".join(
        [
            _descriptive_sql("events", ("value",)), _FULL_OUTLIERS_SQL, _FULL_AGG_SQL, _FULL_TREND_SQL,
            _corr_items(
                _pairs_sql("events", ("value", "user_id"), _pearson_one)
                + " UNION ALL " + _pairs_sql("events", ("value", "user_id"), _spearman_one)
            ),
        ]
    ),
)
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every analysis on events; outliers by the closed-form methods, and of the series its trend."""
    plan = [
        {"type": "descriptive", "columns": ["value"]},
        {"type": "correlation", "columns": list(_EVENT_COLUMNS), "methods": ["pearson", "spearman"]},
        {"type": "outliers", "columns": ["value"], "methods": ["iqr", "zscore"]},
        {"type": "aggregation", "columns": ["value"]},
    ]
    results = analyses.full_run(table(spark, sf_dir, "events"), ["event_id"], analyses=plan)
    trend = analyses.melted_trend(ts.linear_trend(all_events(spark, sf_dir)), "value")
    united = analyses.unite(results).unionByName(trend.filter(F.col("stat") != "p_value"))
    return united.withColumn("value", rounded("value", 4))


def _series_part(analysis: str, item: str, stats_: tuple[str, ...], sql: str) -> str:
    """One part of a series run as (analysis, item, stat, value); ``item`` names the column besides the series', if any."""
    name = f"'total | ' || {item}" if item else "'total'"
    values = ", ".join(f'CAST("{s}" AS DOUBLE) AS "{s}"' for s in stats_)
    listed = ", ".join(f'"{s}"' for s in stats_)
    return f"""SELECT 'timeseries.{analysis}' AS analysis, item, stat, round(value, 4) AS value FROM (
      SELECT {name} AS item, {values} FROM ({sql})) UNPIVOT INCLUDE NULLS (value FOR stat IN ({listed}))"""


def _daily_calendar_sql(labels, slot: str, least: int) -> str:
    slots = ", ".join(f"({i}::BIGINT, '{label}')" for i, label in enumerate(labels))
    return f"""SELECT label, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS count FROM (VALUES {slots}) c(slot, label)
      LEFT JOIN (SELECT {slot} - 1 AS slot, v FROM {_DAILY}) d USING (slot) WHERE (SELECT count(*) FROM {_DAILY}) >= {least} GROUP BY slot, label"""


@register(
    "full_run_series",
    " UNION ALL ".join(
        [
            _series_part("trend", "trend_direction", ("slope", "intercept", "r_squared", "std_error", "trend_strength"), SQL["linear_trend"]),
            _series_part("moving_average", '"window"', ("current_value", "change_from_start"), SQL["moving_average_summary"]),
            _series_part("growth", "", ("mean", "std", "min", "max"), SQL["growth_pop"]),
            _series_part("growth_yoy", "", ("mean", "std", "current"), SQL["growth_yoy"]),
            _series_part("seasonal_strength", "period", ("strength",), SQL["seasonal_strength"]),
            _series_part("day_of_week", "label", ("mean", "std", "count"), _daily_calendar_sql(ts.WEEKDAYS, "isodow(ts)", 14)),
            _series_part("month", "label", ("mean", "std", "count"), _daily_calendar_sql(ts.MONTHS, "month(ts)", 24)),
            _series_part(
                "basic", "", ("observations", "range_days"),
                f"SELECT count(*) AS observations, date_diff('day', min(ts), max(ts)) AS range_days FROM {_DAILY}",
            ),
            _series_part(
                "volatility", "", ("volatility", "annualized_volatility", "value_at_risk_5pct", "value_at_risk_1pct"), SQL["volatility"]
            ),
            _series_part("drawdown", "", ("max_drawdown",), SQL["max_drawdown"]),
            _series_part("momentum", "step", ("momentum",), SQL["momentum"]),
            _series_part("autocorrelation", "lag", ("autocorr",), SQL["autocorrelation"]),
        ]
    ),
)
def full_run_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve parts of a series run, over the daily totals of all orders."""
    results = analyses.full_run(daily_orders(spark, sf_dir), ["day"], ["total"], analyses=["timeseries"])
    return analyses.unite(results).filter(F.col("stat") != "p_value").withColumn("value", rounded("value", 4))


@register("full_run_all")
def full_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every analysis with its default methods, forest and Kendall included."""
    events = table(spark, sf_dir, "events")
    results = analyses.full_run(events, ["event_id"], ["value", "user_id"])
    return analyses.unite(results).withColumn("value", rounded("value"))


_FLOW_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", stddev_samp({c}) / avg({c}) AS cv FROM lineitem" for c in LINE_COLUMNS
)


@register(
    "workflow_csv",
    f"""
    SELECT subject, title, round(score, 6) AS priority_score, rank,
           CASE WHEN rank - 1 < n * 0.2::DOUBLE THEN 'HIGH' WHEN rank - 1 < n * 0.6::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS final_priority,
           CASE WHEN 0.27 + 0.4 * least(cv, 1) >= 0.6 THEN 'HIGH' WHEN 0.27 + 0.4 * least(cv, 1) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS final_risk
    FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, count(*) OVER () AS n FROM (
      SELECT "column" AS subject, 'Reduce Variability in ' || "column" AS title, cv,
             {_id('variability', '"column"', "'cv'")} AS id, least(1, 0.2 * least(cv, 1) + 0.4 * 0.6 + 0.3 * 0.6 + 0.1 * 0.8) AS score
      FROM ({_FLOW_STATS_SQL}) WHERE cv > 0.5))""",
)
def workflow_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of line items through collection, statistics and decision."""
    path = scratch_path(spark, "line-items")
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", *LINE_COLUMNS).write.csv(path, header=True)
    collected = workflow.collect(spark, path)
    decided = workflow.decide_on(collected.table, ["l_orderkey"], LINE_COLUMNS, ["descriptive"])
    return decided.recommendations.select(
        "subject", "title", rounded("priority_score").alias("priority_score"), "rank", "final_priority", "final_risk"
    )
