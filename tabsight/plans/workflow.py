"""The whole path: collect a CSV table, analyse it, decide.

Each step returns lazy tables; only small decisions (one row per column or file) are taken
on the driver to build the next plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.functions.columns import numeric_columns, temporal_column
from tabsight.operators import clean, correlation, outliers, profile, ranking, rules, stats, validate
from tabsight.plans import analyses, decisions
from tabsight.sources import csv, dictionary
from tabsight.sources.scratch import materialize


@dataclass
class Collected:
    """A cleaned table with what was learned about it."""

    table: DataFrame
    preflight: DataFrame
    types: DataFrame
    missing: DataFrame
    alerts: DataFrame
    profile: DataFrame
    issues: DataFrame | None = None
    dictionary: DataFrame | None = None


def _typed(table: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns recognised as dates or booleans take those types."""
    out = []
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string" and types.get(f.name) == "TEMPORAL":
            c = clean.coerce_temporal(c)
        elif f.dataType.simpleString() == "string" and types.get(f.name) == "BOOLEAN":
            c = clean.coerce_boolean(c)
        out.append(c.alias(f.name))
    return table.select(*out)


def collect(
    spark: SparkSession, path: str, data_dictionary: str | None = None, delimiter: str = ",",
    tables: Mapping[str, DataFrame] | None = None,
) -> Collected:
    """Preflight, scan, infer, profile, validate and normalise a CSV table.

    Keys of the dictionary are checked, foreign ones against ``tables`` by name.

    Raises ValueError when the preflight finds errors.  The scanned text and the normalised table are
    written once as columnar tables, so that the passes over them do not parse CSV or numbers again.
    """
    checked = csv.preflight(spark, path, delimiter)
    bad = checked.filter(F.size("errors") > 0).select("file", "errors")
    broken = bad.limit(5).collect()
    if broken:
        named = "; ".join(f"{r['file']}: {', '.join(r['errors'])}" for r in broken)
        raise ValueError(named if len(broken) < 5 else f"{bad.count()} files have errors, among them {named}")
    raw = materialize(csv.read_csv(spark, path, delimiter), "scanned")
    general = materialize(clean.general_normalize(raw), "normalized")
    types = profile.detect_types(general)
    rules_by_column, listed, issues = {}, None, None
    if data_dictionary:
        listed = dictionary.parse_dictionary(spark, data_dictionary, types)
        rules_by_column = dictionary.rules_of(listed)
        issues = validate.validate(raw, listed, rules_by_column, dictionary.keys_of(spark, data_dictionary), tables)
    found = {r["column"]: r["data_type"] for r in types.collect()}
    normal = clean.normalize(raw, rules_by_column) if rules_by_column else general  # without rules the same
    table = _typed(normal, {c: t for c, t in found.items() if c not in rules_by_column})
    missing = profile.missing_report(raw)
    return Collected(
        table, checked, types, missing, profile.missing_alerts(missing), profile.data_profile(table), issues, listed
    )


@dataclass
class Decided:
    """Recommendations with priority and risk, and the tables around them."""

    recommendations: DataFrame
    distribution: DataFrame
    mitigations: DataFrame
    summary: DataFrame
    insights: DataFrame | None = None
    parts: dict[str, DataFrame] = field(default_factory=dict)


def decide_on(
    table: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str] | None = None,
    kinds: Sequence[str] = ("descriptive", "correlation", "outliers", "timeseries"),
    methods: Mapping[str, Sequence[str]] | None = None,
) -> Decided:
    """Run the analyses the rules read and turn them into ranked recommendations."""
    methods = methods or {}
    names = numeric_columns(table, columns) if columns else [c for c in numeric_columns(table) if c not in ids]
    parts: dict[str, DataFrame] = {}
    if "outliers" in kinds:
        chosen = methods.get("outliers", outliers.DEFAULT_METHODS)
        grid = outliers.method_grid(table, names, chosen)
        parts["outliers"] = outliers.summarize(outliers.detect(table, ids, names, chosen), grid)
    if "correlation" in kinds and len(names) > 1:
        parts["correlations"] = correlation.correlations(table, names, methods.get("correlation", correlation.METHODS))
    ts = temporal_column(table)
    if "timeseries" in kinds and ts:
        parts["trends"] = analyses.trends(table, names, ts, ids)
    if "descriptive" in kinds:
        parts["stats"] = stats.describe(table, names)
    # ranking, risk and summary all read the recommendations
    decided = materialize(decisions.decide(decisions.recommend(**parts)), "decided")
    seen = [parts.get("outliers"), parts.get("correlations"), parts.get("trends")]
    return Decided(
        decided,
        rules.risk_distribution(decided),
        rules.mitigations(decided),
        rules.decision_summary(decided),
        rules.insights(*seen) if any(p is not None for p in seen) else None,
        parts,
    )


def compare_strategies(results: DataFrame, entity: str) -> dict[str, DataFrame]:
    """Scores, ranks, Pareto split and best entities of a scenario table."""
    scores = materialize(ranking.criterion_scores(results, [entity]), "scores")
    ranks = ranking.criterion_rank(scores, entity)
    return {
        "scores": scores,
        "ranks": ranks,
        "pareto": ranking.dominance_split(scores, entity),
        "best_overall": ranking.best_overall(ranks, entity),
        "best_per_criterion": ranking.best_per_criterion(ranks, entity),
    }
