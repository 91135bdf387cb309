"""Rules on the sample run's values, ranking and the Pareto front against brute force."""

import numpy as np
import pandas as pd
import pytest

from tabsight.operators import ranking, rules
from tabsight.plans import decisions

# coefficients of variation of the sample run (500,000 rows), highest first
SAMPLE_RUN = {
    "Last_Maintenance_Days_Ago": 0.5791384452249845, "Operational_Hours": 0.5770935765333737,
    "Power_Consumption_kW": 0.5333163348841936, "Vibration_mms": 0.5003962968226392,
}


def test_sample_run_priorities_and_risks(spark):
    stats = spark.createDataFrame([(c, 1.0, cv) for c, cv in SAMPLE_RUN.items()] + [("calm", 1.0, 0.5)], "column string, mean double, std double")
    decided = {r["subject"]: r for r in decisions.decide(decisions.recommend(stats=stats)).collect()}
    assert [decided[c]["final_priority"] for c in SAMPLE_RUN] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert {r["final_risk"] for r in decided.values()} == {"MEDIUM"} and len(decided) == 4
    first = decided["Last_Maintenance_Days_Ago"]
    assert first["title"] == "Reduce Variability in Last_Maintenance_Days_Ago"
    assert "(CV: 0.579)" in first["description"] and first["timeline"] == "3-6 weeks"
    assert first["risk_score"] == pytest.approx(0.4 * SAMPLE_RUN["Last_Maintenance_Days_Ago"] + 0.27)


def _recs(spark, rows):
    return spark.createDataFrame(
        rows, "id string, estimated_impact double, required_resources array<string>, timeline string, rule_risk string"
    )


@pytest.mark.parametrize("n,high,medium", [(1, 1, 0), (4, 1, 2), (5, 1, 2), (10, 2, 4)])
def test_rank_buckets(spark, n, high, medium):
    recs = _recs(spark, [(f"r{i:02d}", 0.5, ["a"], "later", "LOW") for i in range(n)])  # all tied: the id decides
    out = rules.prioritize(recs).orderBy("rank").collect()
    assert [r["id"] for r in out] == sorted(r["id"] for r in out)
    levels = [r["final_priority"] for r in out]
    assert levels == ["HIGH"] * high + ["MEDIUM"] * medium + ["LOW"] * (n - high - medium)


def test_scores_clamp_and_match_first_timeline(spark):
    recs = _recs(spark, [
        ("a", 9.0, ["x"] * 12, "Immediate", "CRITICAL"), ("b", 0.0, [], "1-3 weeks", "HIGH"), ("c", 0.1, ["x"] * 8, "1-2 Months", "MINIMAL"),
    ])
    p = {r["id"]: r["priority_score"] for r in rules.prioritize(recs).collect()}
    assert p["a"] == 1.0 and p["b"] == pytest.approx(0.8 * 0.4 + 0.5 * 0.3 + 0.1) and p["c"] == pytest.approx(0.02 + 0.08 + 0.15 + 0.02)
    risk = {r["id"]: (r["risk_score"], r["final_risk"]) for r in rules.assess_risk(recs).collect()}
    assert risk["a"] == (1.0, "CRITICAL") and risk["b"][1] == "MINIMAL" and risk["b"][0] == pytest.approx(0.18)
    assert risk["c"][0] == pytest.approx(0.04 + 0.09 + 0.3)
    spread = {r["level"]: r["recommendations"] for r in rules.risk_distribution(rules.assess_risk(recs)).collect()}
    assert spread == {"CRITICAL": 1, "HIGH": 0, "MEDIUM": 1, "LOW": 0, "MINIMAL": 1}


def test_outlier_and_trend_rules(spark):
    summary = spark.createDataFrame([("iqr", "a", 21, 21.0), ("iqr", "b", 11, 11.0), ("iqr", "c", 6, 6.0), ("iqr", "d", 5, 5.0)],
                                    "method string, column string, count long, percent double")
    got = {r["subject"]: (r["rule_priority"], r["timeline"]) for r in rules.outlier_recommendations(summary).collect()}
    assert got == {"a": ("HIGH", "1-2 weeks"), "b": ("MEDIUM", "2-4 weeks"), "c": ("LOW", "1-2 months")}
    trends = spark.createDataFrame([("u", "increasing", 0.9), ("d", "decreasing", 0.8), ("w", "decreasing", 0.7)],
                                   "column string, trend_direction string, trend_strength double")
    got = {r["subject"]: (r["rule_priority"], r["rule_risk"], r["timeline"]) for r in rules.trend_recommendations(trends).collect()}
    assert got == {"u": ("MEDIUM", "LOW", "1-2 months"), "d": ("HIGH", "HIGH", "1-3 weeks")}
    assert rules.insights(trends=trends).count() == 3


def test_ids_are_stable_and_scoped(spark):
    stats = spark.createDataFrame([(s, "x", 1.0, 0.9) for s in (1, 2)], "seg int, column string, mean double, std double")
    a = {r["id"] for r in rules.variability_recommendations(stats, ["seg"]).collect()}
    b = {r["id"] for r in rules.variability_recommendations(stats.repartition(3), ["seg"]).collect()}
    assert a == b and len(a) == 2


@pytest.mark.parametrize("step", [10_000, 25, 3])
def test_pareto_front_in_rounds(spark, step):
    rng = np.random.default_rng(9)
    pts = np.round(rng.normal(0, 1, (400, 3)), 1)
    pts = np.vstack([pts, pts[:50]])  # equal entities
    dominated = np.array([((pts >= p).all(1) & (pts > p).any(1)).any() for p in pts])
    pdf = pd.DataFrame(pts, columns=["a", "b", "c"]).assign(e=range(len(pts)))
    df = spark.createDataFrame(pdf).repartition(4)
    front = {r["e"] for r in ranking.pareto_front(df, "e", ["a", "b", "c"], step=step).collect()}
    assert front == set(np.flatnonzero(~dominated))


@pytest.mark.parametrize("step", [2, 50])
def test_incomparable_rows_are_never_on_the_front(spark, step):
    rows = [(i, float(i), float(-i)) for i in range(6)] + [(100, None, 9.0), (101, float("nan"), 9.0)]
    df = spark.createDataFrame(rows, "e int, a double, b double")
    assert {r["e"] for r in ranking.pareto_front(df, "e", ["a", "b"], step=step).collect()} == set(range(6))
    assert not any(r["pareto_efficient"] for r in ranking.dominance_split(df, "e", ["a", "b"]).collect() if r["e"] > 99)


@pytest.mark.parametrize("step", [2, 50])
def test_front_keeps_large_ids_beside_a_null_one(spark, step):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, -(1 << 60) - 1, 0]
    df = spark.createDataFrame([(e, float(i), float(-i)) for i, e in enumerate(ids)], "e long, a double, b double").repartition(1)
    got = ranking.pareto_front(df, "e", ["a", "b"], step=step)
    assert {(r["e"], r["a"]) for r in got.collect()} == {(e, float(i)) for i, e in enumerate(ids)}
    assert got.columns == ["e", "a", "b"]


def test_all_on_the_front(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(300)], "e int, a double, b double")
    assert ranking.pareto_front(df, "e", ["a", "b"], step=40).count() == 300


def test_ranking_and_best(spark):
    df = spark.createDataFrame([("s1", 1.0, 3.0), ("s2", 2.0, 2.0), ("s3", 2.0, 1.0)], "e string, a double, b double")
    ranks = ranking.criterion_rank(df, "e", ["a", "b"])
    got = {(r["criterion"], r["e"]): r["rank"] for r in ranks.collect()}
    assert got == {("a", "s2"): 1, ("a", "s3"): 2, ("a", "s1"): 3, ("b", "s1"): 1, ("b", "s2"): 2, ("b", "s3"): 3}
    assert ranking.best_overall(ranks, "e").first()["e"] == "s2"
    assert {(r["criterion"], r["e"]) for r in ranking.best_per_criterion(ranks, "e").collect()} == {("a", "s2"), ("b", "s1")}


def test_scenario_defaults(spark):
    df = spark.createDataFrame(
        [("s", {"cost": 2.0, "time": 1.0}, {"cost": 100.0}, {}, {}, {}, {})],
        "e string, parameters map<string,double>, expected_outcomes map<string,double>, predicted_outcomes map<string,double>, "
        "resource_utilization map<string,double>, risk_assessment map<string,double>, timeline_impact map<string,double>",
    )
    got = {r["parameter"]: (r["predicted"], r["low"], r["high"]) for r in ranking.whatif_projection(df, ["e"]).collect()}
    assert got["cost"] == pytest.approx((120.0, 96.0, 144.0)) and got["time"] == (0.0, 0.0, 0.0)
    r = ranking.criterion_scores(df, ["e"]).first()
    assert (r["cost_effectiveness"], r["risk_reduction"]) == (0.0, 0.5)
    assert r["timeline_efficiency"] == pytest.approx(1 - 90 / 365) and r["resource_utilization"] == pytest.approx(0.8)
