"""Profiling, type inference, cleaning, validation and CSV sources on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabsight.operators import clean, profile, validate
from tabsight.sources import csv, dictionary, results


def _types(df):
    return {r["column"]: r["data_type"] for r in profile.detect_types(df).collect()}


def test_type_inference_order(spark):
    rows = [
        (i, f"2024-01-{i % 28 + 1:02d}", ["TRUE", "False", None][i % 3], "ab"[i % 2], f"note {i}", None, i % 2, str(i))
        for i in range(120)
    ]
    df = spark.createDataFrame(
        rows, "n int, day string, flag string, cat string, free string, gone string, bit int, digits string"
    )
    df = df.withColumn("truth", F.col("n") > 3).withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert _types(df) == {
        "n": "NUMERICAL", "day": "TEMPORAL", "flag": "BOOLEAN", "cat": "CATEGORICAL", "free": "TEXT", "gone": "TEXT",
        "bit": "NUMERICAL", "digits": "TEXT", "truth": "BOOLEAN", "at": "TEMPORAL",
    }


def test_half_dates_are_not_temporal_and_three_tokens_not_boolean(spark):
    df = spark.createDataFrame(
        [("01/02/2024", "yes"), ("x", "no"), ("03-04-2024", "t"), ("y", "yes")], "mixed string, token string"
    )
    assert _types(df) == {"mixed": "TEXT", "token": "TEXT"}


@pytest.mark.parametrize("distinct,rows,kind", [(50, 200, "CATEGORICAL"), (51, 200, "TEXT"), (5, 10, "TEXT"), (5, 11, "CATEGORICAL")])
def test_category_limits(spark, distinct, rows, kind):
    df = spark.range(rows).select(F.concat(F.lit("c"), F.col("id") % distinct).alias("c"))
    assert _types(df) == {"c": kind}


def test_profile_counts_long_text_exactly(spark):
    long_a, long_b = "x" * 500, "x" * 499 + "y"
    df = spark.createDataFrame([(long_a, 1), (long_b, None), (long_a, 3), (None, 3)], "t string, n int")
    got = {r["column"]: r for r in profile.data_profile(df).collect()}
    assert (got["t"]["distinct"], got["t"]["missing"], got["t"]["rows"]) == (2, 1, 4)
    assert got["t"]["memory_mb"] == pytest.approx(1500 / 1048576) and got["n"]["memory_mb"] == pytest.approx(12 / 1048576)


def test_missing_report_of_an_empty_table(spark):
    report = profile.missing_report(spark.createDataFrame([], "a int, b string"))
    assert [(r["missing"], r["percent"]) for r in report.collect()] == [(0, 0.0), (0, 0.0)]


def test_normalize_ignores_nulls_when_promoting(spark):
    df = spark.createDataFrame([(" 1 ", " a ", "3."), ("", "   ", "-4.5"), (None, "b", None)], "num string, txt string, dot string")
    out = clean.general_normalize(df)
    assert dict(out.dtypes) == {"num": "double", "txt": "string", "dot": "double"}
    assert [tuple(r) for r in out.collect()] == [(1.0, "a", 3.0), (None, None, -4.5), (None, "b", None)]


def test_exponents_stay_text_but_coerce(spark):
    df = spark.createDataFrame([("1e5",), ("2",)], "v string")
    assert clean.general_normalize(df).dtypes == [("v", "string")]
    assert [r[0] for r in df.select(clean.coerce_numeric(F.col("v"))).collect()] == [1e5, 2.0]


def test_temporal_formats(spark):
    df = spark.createDataFrame([("2024-03-01",), ("03/31/2024",), ("12-25-2023",), ("13/13/2024",), ("soon",)], "v string")
    got = [r[0] for r in df.select(clean.coerce_temporal(F.col("v"))).collect()]
    assert got == [dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 31), dt.datetime(2023, 12, 25), None, None]


MAINTENANCE = """{"columns": {
  "equipment_id": {"data_type": "categorical", "is_nullable": false},
  "failure_type": {"data_type": "categorical", "categorical_values": ["mechanical", "electrical", "software", "other"]},
  "temperature": {"data_type": "numerical", "unit": "C", "valid_range": [-20, 100]},
  "runtime_hours": {"data_type": "numerical", "is_nullable": false},
  "absent": {}}}"""


def test_dictionary_validation(spark):
    df = spark.createDataFrame(
        [("e1", "mechanical", "12.5", 3.0), ("e2", "rust", "101", None), (None, "rust", "warm", 1.0), ("e4", None, "-20", 1.0)],
        "equipment_id string, failure_type string, temperature string, runtime_hours double",
    ).withColumn("extra", F.lit(1))
    listed = dictionary.parse_dictionary(spark, MAINTENANCE)
    rules = dictionary.rules_of(listed)
    assert rules["absent"].data_type == "TEXT" and rules["temperature"].valid_range == (-20.0, 100.0)
    issues = {(r["severity"], r["rule"], r["column"]): r["n"] for r in validate.validate(df, listed, rules).collect()}
    assert issues == {
        ("error", "missing_column", "absent"): 1, ("warning", "extra_column", "extra"): 1,
        ("error", "nullability", "equipment_id"): 1, ("error", "nullability", "runtime_hours"): 1,
        ("warning", "range", "temperature"): 1, ("warning", "domain", "failure_type"): 1,
    }
    assert [(r["value"], r["n"]) for r in validate.invalid_values(df, rules).collect()] == [("rust", 2)]
    assert validate.verdict(validate.validate(df, listed, rules)).first()["is_valid"] is False
    cleaned = clean.normalize(df, rules).collect()
    assert [r["temperature"] for r in cleaned] == [12.5, 101.0, None, -20.0]
    assert [r["failure_type"] for r in cleaned] == ["mechanical", None, None, None]


def test_csv_scan_and_fallback(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a;b\n1;été\nN/A;-\n?;x\n", encoding="utf-8")
    (tmp_path / "l.csv").write_text("a;b\n2;été\n", encoding="latin-1")
    back = csv.read_csv(spark, str(tmp_path), delimiter=";")
    assert {(r["a"], r["b"]) for r in back.collect()} == {("1", "été"), (None, None), (None, "x"), ("2", "été")}
    census = {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in csv.encoding_census(spark, str(tmp_path)).collect()}
    assert census == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1"}


def test_csv_preflight(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('a,b\n1,"x,y"\n2,z\n')
    (tmp_path / "wide.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "one.log").write_text("a\n1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.txt").write_text("\n\n")
    got = {r["file"].rsplit("/", 1)[1]: r for r in csv.preflight(spark, [str(tmp_path), str(tmp_path / "nope.csv")]).collect()}
    assert (got["ok.csv"]["columns"], got["ok.csv"]["data_rows"], got["ok.csv"]["errors"], got["ok.csv"]["warnings"]) == (2, 2, [], [])
    assert "more fields" in got["wide.csv"]["errors"][0]
    assert len(got["one.log"]["warnings"]) == 2 and got["one.log"]["errors"] == []
    assert got["empty.csv"]["errors"] == ["File is empty"]
    assert got["blank.txt"]["errors"] == ["No columns detected in CSV file"]
    assert got["nope.csv"]["errors"][0].startswith("File does not exist")


@pytest.mark.parametrize("fmt", results.FORMATS)
def test_result_sink(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "stat string, value double")
    results.write_results(df, str(tmp_path / fmt), fmt)
    assert sorted(map(tuple, results.read_results(spark, str(tmp_path / fmt), df.schema, fmt).collect())) == [("a", 1.5), ("b", None)]
    with pytest.raises(ValueError):
        results.write_results(df, str(tmp_path / "x"), "docx")
