"""Whole runs: a CSV file in, decisions out; targeted runs; and the query registry."""

import json
import os

import pytest

import __spark_entry__ as driver
from tabsight.plans import analyses, workflow
from tabsight.sources import csv
from tests import oracle

SMALL = "/root/testdata/sf0.001"
# a cross-section that runs quickly; TABSIGHT_ALL_QUERIES=1 compares every query
SAMPLE = (
    "csv_scan_na", "detect_types", "data_profile", "normalize_table", "validation_issues", "describe_grouped",
    "agg_grouped_gaps", "corr_spearman_gaps", "corr_kendall", "outlier_consensus", "moving_average_by_user",
    "seasonal_profile", "autocorrelation_by_user", "risk_distribution", "pareto_front", "criterion_rank", "state_duration",
    "validate_records", "extract_json", "workflow_csv",
)


@pytest.fixture(scope="module")
def machine_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "machines.csv"
    lines = ["row,at,load,wear,on,site"]
    for i in range(330):
        load = "N/A" if i % 50 == 3 else (500 if i % 97 == 5 else 10 + i % 7)
        lines.append(f"{i},2024-{i // 28 + 1:02d}-{i % 28 + 1:02d},{load},{i * 2 + 1},{'yes' if i % 2 else 'No'}, s{i % 3} ")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_collect_and_decide(spark, machine_csv):
    listed = json.dumps({"columns": {"load": {"data_type": "numerical", "valid_range": [0, 100], "is_nullable": False}, "gone": {}}})
    got = workflow.collect(spark, machine_csv, listed)
    types = dict(got.table.dtypes)
    assert types == {"row": "double", "at": "timestamp_ntz", "load": "double", "wear": "double", "on": "boolean", "site": "string"}
    assert {r["site"] for r in got.table.select("site").distinct().collect()} == {"s0", "s1", "s2"}
    kinds = {(r["rule"], r["column"]): r["n"] for r in got.issues.collect()}
    assert kinds["missing_column", "gone"] == 1 and kinds["nullability", "load"] == 7 and kinds["range", "load"] == 4
    assert {r["column"]: r["missing"] for r in got.missing.collect()}["load"] == 7
    decided = workflow.decide_on(got.table, ["row"], methods={"correlation": ["pearson"], "outliers": ["iqr", "percentile"]})
    by_rule = {}
    for r in decided.recommendations.collect():
        by_rule.setdefault(r["rule"], set()).add(r["subject"])
    assert "wear" in by_rule["trend"] and "load" in by_rule["variability"]
    assert sum(r["recommendations"] for r in decided.distribution.collect()) == decided.summary.first()["total_recommendations"]
    assert decided.insights.count() >= 2


def test_collect_refuses_broken_files(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(ValueError, match="more fields"):
        workflow.collect(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="does not exist"):
        workflow.collect(spark, str(tmp_path / "none.csv"))


def test_targeted_runs(spark):
    df = spark.range(40).selectExpr("id", "double(id * id) a", "double(id % 5) b", "string(id) t")
    default = analyses.analyze(df, ["id"])
    assert set(default) == {"descriptive", "correlation"}
    some = analyses.analyze(df, ["id"], ["outliers", "nonsense", "timeseries"], ["a"])
    assert set(some) == {"outliers"}  # no date column, no series
    assert analyses.unite(default).columns == ["analysis", "item", "stat", "value"]


def test_strategies(spark):
    schema = (
        "s string, predicted_outcomes map<string,double>, resource_utilization map<string,double>, "
        "risk_assessment map<string,double>, timeline_impact map<string,double>"
    )
    rows = [
        ("good", {"x": 9.0}, {"a": 0.7}, {"overall_risk": 0.1}, {"implementation_days": 10.0}),
        ("bad", {"x": 1.0}, {"a": 0.2}, {"overall_risk": 0.7}, {"implementation_days": 80.0}),
    ]
    got = workflow.compare_strategies(spark.createDataFrame(rows, schema), "s")
    assert got["best_overall"].first()["s"] == "good"
    assert {r["s"]: r["pareto_efficient"] for r in got["pareto"].collect()} == {"good": True, "bad": False}
    assert got["best_per_criterion"].count() == 4


def test_registry_is_complete():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert set(SAMPLE) <= set(sql)


def test_entry(spark):
    out = driver.entry(spark)
    assert out.count() > 0 and "final_priority" in out.columns


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", list(driver.oracle_sql()) if os.environ.get("TABSIGHT_ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    got = driver.queries()[name](spark, SMALL).toPandas()
    verdict = oracle.compare(got, con.execute(driver.oracle_sql()[name]).df())
    assert not verdict or verdict.startswith("~"), verdict


def test_quoted_line_breaks_and_doubled_quotes(spark, tmp_path):
    f = tmp_path / "q.csv"
    f.write_text('id,text,v\n1,"say ""hi"", ok",3\n2,"two\nlines",4\n3,plain,5\n')
    rows = [tuple(r) for r in csv.read_csv(spark, str(f)).orderBy("id").collect()]
    assert rows == [("1", 'say "hi", ok', "3"), ("2", "two\nlines", "4"), ("3", "plain", "5")]
    checked = csv.preflight(spark, str(f)).first()
    assert (checked["columns"], checked["data_rows"], checked["errors"]) == (3, 3, [])
    g = tmp_path / "plain.csv"
    g.write_text('id,text\n1,"a ""b"""\n')
    assert not csv.encoding_census(spark, str(g)).first()["multi_line"]


def test_dates_written_by_spark_survive_the_workflow(spark, tmp_path):
    path = str(tmp_path / "dates")
    spark.sql("SELECT id, timestamp_ntz'2024-01-31 10:00:00.5' + make_dt_interval(CAST(id AS INT)) AS day, id * 1.5 AS v FROM range(40)").coalesce(1).write.csv(path, header=True)
    table = workflow.collect(spark, path).table
    assert dict(table.dtypes)["day"] == "timestamp_ntz" and table.filter("day is null").count() == 0


def test_a_failing_analysis_leaves_the_others(spark, monkeypatch):
    df = spark.range(30).selectExpr("id", "id * 2.0 AS v")
    monkeypatch.setattr(analyses, "aggregation", lambda *a: 1 / 0)
    got = analyses.unite(analyses.analyze(df, ["id"], ["descriptive", "aggregation"])).collect()
    assert {r["analysis"] for r in got} == {"descriptive", "aggregation"}
    assert [r["item"][:17] for r in got if r["stat"] == "error"] == ["ZeroDivisionError"]


def test_text_is_not_converted_or_scanned_again(spark, machine_csv):
    checked = csv.preflight(spark, machine_csv)
    assert "text" not in checked._jdf.queryExecution().optimizedPlan().toString().lower()  # one row per file is read back
    got = workflow.collect(spark, machine_csv)
    plan = got.table.select("row", "wear", "load")._jdf.queryExecution().optimizedPlan().toString()
    assert "cast" not in plan and "trim" not in plan.lower()
    assert sorted(r["wear"] for r in got.table.select("wear").collect()) == [2.0 * i + 1 for i in range(330)]


def test_preflight_takes_the_header_from_the_first_of_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 400 + '"x,y",2\n' + "\n   \n")
    (tmp_path / "b.csv").write_text("a,b,c\n" + "1,2\n" * 400 + "1,2,3,4\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = {r["file"].rsplit("/", 1)[1]: r for r in csv.preflight(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (got["a.csv"]["columns"], got["a.csv"]["data_rows"], got["a.csv"]["errors"]) == (2, 401, [])
    assert (got["b.csv"]["columns"], got["b.csv"]["data_rows"], got["b.csv"]["errors"]) == (3, 401, [csv.WIDE_ROW])
