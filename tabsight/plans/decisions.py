"""From analysis tables to ranked, risk-scored recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabsight.operators import rules


def recommend(
    outliers: DataFrame | None = None,
    correlations: DataFrame | None = None,
    trends: DataFrame | None = None,
    stats: DataFrame | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """All rules over whatever analyses are given."""
    parts = []
    if outliers is not None:
        parts.append(rules.outlier_recommendations(outliers, scope))
    if correlations is not None:
        parts.append(rules.correlation_recommendations(correlations, scope))
    if trends is not None:
        parts.append(rules.trend_recommendations(trends, scope))
    if stats is not None:
        parts.append(rules.variability_recommendations(stats, scope))
    if not parts:
        raise ValueError("no analysis given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decide(recommendations: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Priority first, on the rule's own risk; then the final risk by score."""
    return rules.assess_risk(rules.prioritize(recommendations, scope))
