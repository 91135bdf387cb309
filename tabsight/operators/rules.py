"""From statistics to findings: insights, recommendations, priority and risk.

All inputs and outputs are long tables, so the rules are filters and column expressions.
``scope`` names optional leading columns (one analysed segment each); without it the
whole input is one scope.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsight.functions.moments import variation
from tabsight.operators.correlation import STRONG, strong_pairs
from tabsight.operators.ordered import rank_within

TREND_INSIGHT = 0.5
OUTLIER_PERCENT = 5
STRONG_FOR_ACTION = 0.8
TREND_FOR_ACTION = 0.7
HIGH_VARIATION = 0.5

# Texts of the rules, as printf templates.
OUTLIER_TITLE = "Investigate %s Anomalies"
OUTLIER_TEXT = (
    "Column '%s' shows %d outliers (%.1f%% of data) detected by %s method. "
    "These anomalies may indicate data quality issues or equipment malfunctions."
)
OUTLIER_EVIDENCE = ("Outlier detection method: %s", "Outlier count: %d", "Percentage of data affected: %.1f%%")
OUTLIER_RESOURCES = ("Data analyst", "Domain expert")
CORRELATION_TITLE = "Leverage %s Correlation: %s - %s"
CORRELATION_TEXT = (
    "Strong %s correlation (%.3f) detected between '%s' and '%s'. "
    "This relationship can be leveraged for predictive maintenance or optimization."
)
CORRELATION_EVIDENCE = ("Correlation coefficient: %.3f", "Analysis method: %s", "Relationship type: %s")
CORRELATION_RESOURCES = ("Data scientist", "Process engineer")
TREND_ACTIONS = {"decreasing": "Address declining performance", "other": "Optimize improving performance"}
TREND_ADVICE = {
    "decreasing": "Immediate attention required to prevent further degradation.",
    "other": "Opportunity to further optimize performance.",
}
TREND_TITLE = "%s: %s"
TREND_TEXT = "Strong %s trend detected in '%s' (strength: %.3f). %s"
TREND_EVIDENCE = ("Trend direction: %s", "Trend strength: %.3f", "Column analyzed: %s")
TREND_RESOURCES = ("Maintenance team", "Equipment specialist")
VARIABILITY_TITLE = "Reduce Variability in %s"
VARIABILITY_TEXT = (
    "High variability detected in '%s' (CV: %.3f). "
    "This indicates inconsistent performance that may benefit from standardization or process improvement."
)
VARIABILITY_EVIDENCE = ("Coefficient of variation: %.3f", "Standard deviation: %.3f", "Mean value: %.3f")
VARIABILITY_RESOURCES = ("Process engineer", "Quality control")
FINDINGS = {
    "outliers": "Detected %d anomalous data points requiring investigation",
    "correlations": "Identified %d strong correlations between variables",
    "trend": "%s shows %s trend over time",
    "actions": "%d high-priority maintenance actions recommended",
}

# Scoring weights, timeline scores (first match counts), risk levels and mitigation steps.
PRIORITY_WEIGHTS = {"impact": 0.2, "risk": 0.4, "timeline": 0.3, "resources": 0.1}
RISK_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.6, "LOW": 0.4, "MINIMAL": 0.2}
TIMELINE_SCORES = (
    ("immediate", 1.0), ("1-2 weeks", 0.9), ("2-4 weeks", 0.7), ("1-2 months", 0.5), ("3-6 weeks", 0.6), ("2-6 weeks", 0.7),
)
TIMELINE_DEFAULT = 0.5
RISK_LEVELS = (("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.4), ("LOW", 0.2), ("MINIMAL", None))
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
MITIGATIONS = {
    "CRITICAL": (
        "Implement phased rollout with pilot testing",
        "Establish dedicated monitoring and rollback procedures",
        "Assign senior technical lead for oversight",
        "Create detailed contingency plans",
    ),
    "HIGH": (
        "Conduct thorough impact assessment before implementation",
        "Establish clear success metrics and monitoring",
        "Plan for additional resource allocation if needed",
        "Schedule regular progress reviews",
    ),
}
GENERAL_MITIGATIONS = (
    "Document all assumptions and dependencies",
    "Establish clear communication channels",
    "Plan for stakeholder training and change management",
)


def anomaly_insights(summary: DataFrame) -> DataFrame:
    """Columns and methods with at least one outlier, from (…, method, column, count, percent)."""
    return summary.filter(F.col("count") > 0)


def correlation_insights(pairs: DataFrame) -> DataFrame:
    """One row per unordered strong pair and method."""
    return strong_pairs(pairs, STRONG)


def trend_insights(trends: DataFrame) -> DataFrame:
    """Series whose trend strength exceeds one half."""
    return trends.filter(F.col("trend_strength") > TREND_INSIGHT)


def insights(
    anomalies: DataFrame | None = None, pairs: DataFrame | None = None, trends: DataFrame | None = None
) -> DataFrame:
    """(kind, subject, detail, value) over the three sources."""
    parts = []
    if anomalies is not None:
        found = anomaly_insights(anomalies)
        parts.append(found.select(F.lit("anomaly").alias("kind"), F.col("column").alias("subject"), F.col("method").alias("detail"), F.col("percent").alias("value")))
    if pairs is not None:
        found = correlation_insights(pairs)
        parts.append(found.select(F.lit("correlation").alias("kind"), F.concat_ws(" - ", "col1", "col2").alias("subject"), F.col("method").alias("detail"), F.col("corr").alias("value")))
    if trends is not None:
        found = trend_insights(trends)
        parts.append(found.select(F.lit("trend").alias("kind"), F.col("column").alias("subject"), F.col("trend_direction").alias("detail"), F.col("trend_strength").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _recommendation(
    df: DataFrame, scope: Sequence[str], rule: str, subject: Column, detail: Column, title: Column, description: Column,
    priority: Column, impact: Column, resources: Sequence[str], timeline: Column, risk: Column, evidence: Sequence[Column],
) -> DataFrame:
    parts = [F.lit(rule), *[F.col(s).cast("string") for s in scope], subject, detail]
    return df.select(
        *scope,
        F.sha2(F.concat_ws("|", *parts), 256).alias("id"),
        F.lit(rule).alias("rule"),
        subject.alias("subject"),
        detail.alias("detail"),
        title.alias("title"),
        description.alias("description"),
        priority.alias("rule_priority"),
        impact.alias("estimated_impact"),
        F.array(*[F.lit(r) for r in resources]).alias("required_resources"),
        timeline.alias("timeline"),
        risk.alias("rule_risk"),
        F.array(*evidence).alias("supporting_evidence"),
    )


def outlier_recommendations(summary: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """More than 5 % flagged values; above 10 % and 20 % it becomes more urgent."""
    rows = summary.filter(F.col("percent") > OUTLIER_PERCENT)
    pct, column, method, count = F.col("percent"), F.col("column"), F.col("method"), F.col("count")
    by_share = lambda high, medium, low: F.when(pct > 20, high).when(pct > 10, medium).otherwise(low)
    return _recommendation(
        rows, scope, "outlier", column, method,
        title=F.format_string(OUTLIER_TITLE, column),
        description=F.format_string(OUTLIER_TEXT, column, count, pct, method),
        priority=by_share("HIGH", "MEDIUM", "LOW"),
        impact=pct / 100.0,
        resources=OUTLIER_RESOURCES,
        timeline=by_share("1-2 weeks", "2-4 weeks", "1-2 months"),
        risk=F.lit("MEDIUM"),
        evidence=[F.format_string(t, v) for t, v in zip(OUTLIER_EVIDENCE, (method, count, pct))],
    )


def correlation_recommendations(pairs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Very strong pairs (above 0.8 in absolute value)."""
    r, one, two = F.col("corr"), F.col("col1"), F.col("col2")
    rows = correlation_insights(pairs).filter(F.abs(r) > STRONG_FOR_ACTION)
    sign = F.when(r > 0, "positive").otherwise("negative")
    return _recommendation(
        rows, scope, "correlation", F.concat_ws(" - ", one, two), F.col("method"),
        title=F.format_string(CORRELATION_TITLE, F.initcap(sign), one, two),
        description=F.format_string(CORRELATION_TEXT, sign, r, one, two),
        priority=F.lit("MEDIUM"),
        impact=F.abs(r),
        resources=CORRELATION_RESOURCES,
        timeline=F.lit("2-6 weeks"),
        risk=F.lit("LOW"),
        evidence=[F.format_string(t, v) for t, v in zip(CORRELATION_EVIDENCE, (r, F.col("method"), sign))],
    )


def trend_recommendations(trends: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Strong trends (above 0.7); a falling one is urgent."""
    column, way, strength = F.col("column"), F.col("trend_direction"), F.col("trend_strength")
    rows = trend_insights(trends).filter(strength > TREND_FOR_ACTION)
    by_way = lambda falling, rising: F.when(way == "decreasing", falling).otherwise(rising)
    return _recommendation(
        rows, scope, "trend", column, way,
        title=F.format_string(TREND_TITLE, by_way(TREND_ACTIONS["decreasing"], TREND_ACTIONS["other"]), column),
        description=F.format_string(
            TREND_TEXT, way, column, strength, by_way(TREND_ADVICE["decreasing"], TREND_ADVICE["other"])
        ),
        priority=by_way("HIGH", "MEDIUM"),
        impact=strength,
        resources=TREND_RESOURCES,
        timeline=by_way("1-3 weeks", "1-2 months"),
        risk=by_way("HIGH", "LOW"),
        evidence=[F.format_string(t, v) for t, v in zip(TREND_EVIDENCE, (way, strength, column))],
    )


def variability_recommendations(stats: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Coefficient of variation above one half, from (scope…, column, mean, std)."""
    rows = stats.withColumn("cv", variation(F.col("std"), F.col("mean"))).filter(F.col("cv") > HIGH_VARIATION)
    cv, column = F.col("cv"), F.col("column")
    return _recommendation(
        rows, scope, "variability", column, F.lit("cv"),
        title=F.format_string(VARIABILITY_TITLE, column),
        description=F.format_string(VARIABILITY_TEXT, column, cv),
        priority=F.lit("MEDIUM"),
        impact=F.least(cv, F.lit(1.0)),
        resources=VARIABILITY_RESOURCES,
        timeline=F.lit("3-6 weeks"),
        risk=F.lit("MEDIUM"),
        evidence=[F.format_string(t, v) for t, v in zip(VARIABILITY_EVIDENCE, (cv, F.col("std"), F.col("mean")))],
    )


def priority_score() -> Column:
    """Score of a recommendation row from impact, rule risk, timeline and number of resources."""
    risk = F.lit(0.5)
    for level, weight in reversed(RISK_WEIGHTS.items()):
        risk = F.when(F.col("rule_risk") == level, weight).otherwise(risk)
    timeline = F.lit(TIMELINE_DEFAULT)
    for text, weight in reversed(TIMELINE_SCORES):
        timeline = F.when(F.contains(F.lower("timeline"), F.lit(text)), weight).otherwise(timeline)
    resources = F.greatest(F.lit(0.1), 1.0 - F.size("required_resources") * 0.1)
    w = PRIORITY_WEIGHTS
    total = F.col("estimated_impact") * w["impact"] + risk * w["risk"] + timeline * w["timeline"] + resources * w["resources"]
    return F.least(F.lit(1.0), total)


def prioritize(recommendations: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Add priority_score, rank and final_priority: top fifth HIGH, next two fifths MEDIUM, rest LOW."""
    scored = recommendations.withColumn("priority_score", priority_score())
    # ties by a rounded score and then the id, so equal recommendations rank alike everywhere
    placed = rank_within(scored, scope, [F.round("priority_score", 9).desc(), F.col("id")])
    ahead = F.col("rank") - 1
    final = (
        F.when(ahead < F.col("_n") * 0.2, "HIGH").when(ahead < F.col("_n") * 0.6, "MEDIUM").otherwise("LOW")
    )
    return placed.withColumn("final_priority", final).drop("_n")


def risk_score() -> Column:
    """Score from impact, timeline class and number of resources."""
    text = F.lower("timeline")
    timeline = (
        F.when(F.contains(text, F.lit("immediate")), 0.9).when(F.contains(text, F.lit("week")), 0.6)
        .when(F.contains(text, F.lit("month")), 0.3).otherwise(0.5)
    )
    resources = F.least(F.lit(1.0), F.size("required_resources") * 0.15)
    return F.least(F.lit(1.0), F.col("estimated_impact") * 0.4 + timeline * 0.3 + resources * 0.3)


def risk_level(score: Column) -> Column:
    """Level of a risk score."""
    level = F.lit(RISK_LEVELS[-1][0])
    for name, floor in reversed(RISK_LEVELS[:-1]):
        level = F.when(score >= floor, name).otherwise(level)
    return level


def assess_risk(recommendations: DataFrame) -> DataFrame:
    """Add risk_score and final_risk."""
    scored = recommendations.withColumn("risk_score", risk_score())
    return scored.withColumn("final_risk", risk_level(F.round("risk_score", 12)))


def risk_distribution(assessed: DataFrame) -> DataFrame:
    """(level, recommendations, overall_risk_score) with all five levels, in order of severity."""
    levels = assessed.sparkSession.createDataFrame(
        [(i, name) for i, (name, _) in enumerate(RISK_LEVELS)], "severity bigint, level string"
    )
    counts = assessed.groupBy(F.col("final_risk").alias("level")).agg(
        F.count("*").alias("n"), F.sum("risk_score").alias("s")
    )
    full = levels.join(counts, "level", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    every = W.partitionBy()  # five rows
    overall = F.coalesce(F.sum("s").over(every) / F.nullif(F.sum("n").over(every), F.lit(0)), F.lit(0.0))
    return full.select("severity", "level", F.col("n").alias("recommendations"), overall.alias("overall_risk_score"))


def high_risk(assessed: DataFrame) -> DataFrame:
    """Recommendations at CRITICAL or HIGH risk."""
    return assessed.filter(F.col("final_risk").isin("CRITICAL", "HIGH"))


def mitigations(assessed: DataFrame) -> DataFrame:
    """(id, final_risk, step, action): the level's actions followed by the general ones."""
    cells = [
        (level, i, action)
        for level, actions in MITIGATIONS.items()
        for i, action in enumerate((*actions, *GENERAL_MITIGATIONS), 1)
    ]
    lookup = assessed.sparkSession.createDataFrame(cells, "final_risk string, step bigint, action string")
    # the lookup is the fixed list above
    return high_risk(assessed).select("id", "final_risk").join(F.broadcast(lookup), "final_risk")


def decision_summary(decided: DataFrame) -> DataFrame:
    """One row: totals of recommendations, HIGH priority and high risk."""
    return decided.agg(
        F.count("*").alias("total_recommendations"),
        F.count_if(F.col("final_priority") == "HIGH").alias("high_priority_count"),
        F.count_if(F.col("final_risk").isin("CRITICAL", "HIGH")).alias("high_risk_count"),
    )


def by_priority(prioritized: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Number recommendations inside each final priority, in rank order."""
    placed = rank_within(prioritized.withColumnRenamed("rank", "overall_rank"), [*scope, "final_priority"], ["overall_rank", "id"])
    return placed.withColumnRenamed("rank", "number").drop("_n")


def key_findings(
    flags_total: DataFrame, pairs: DataFrame, trends: DataFrame, prioritized: DataFrame, limit: int | None = None
) -> DataFrame:
    """(seq, finding): counts of each analysis as sentences, all of them or the first ``limit``.

    ``flags_total`` is one row with ``total``; ``trends`` has (column, trend_direction).
    """
    outliers = flags_total.filter(F.col("total") > 0).select(
        F.lit(1).alias("section"), F.lit("").alias("item"),
        F.format_string(FINDINGS["outliers"], F.col("total")).alias("finding"),
    )
    strong = strong_pairs(pairs).agg(F.count("*").alias("n")).filter(F.col("n") > 0).select(
        F.lit(2).alias("section"), F.lit("").alias("item"),
        F.format_string(FINDINGS["correlations"], F.col("n")).alias("finding"),
    )
    moving = trends.select(
        F.lit(3).alias("section"), F.col("column").alias("item"),
        F.format_string(FINDINGS["trend"], F.col("column"), F.col("trend_direction")).alias("finding"),
    )
    urgent = prioritized.filter(F.col("final_priority") == "HIGH").agg(F.count("*").alias("n")).filter(F.col("n") > 0).select(
        F.lit(4).alias("section"), F.lit("").alias("item"),
        F.format_string(FINDINGS["actions"], F.col("n")).alias("finding"),
    )
    rows = outliers.unionByName(strong).unionByName(moving).unionByName(urgent)
    ordered = rows.orderBy("section", "item").select("section", "item", "finding")
    return ordered if limit is None else ordered.limit(limit)
