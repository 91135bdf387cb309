"""Series metrics against pandas, for one hot series next to short ones and for tiny blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions.tails import student_two_sided
from tabsight.operators import timeseries as ts


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    keys = np.concatenate([np.zeros(900), rng.integers(1, 7, 120), [8] * 2, [9]]).astype(int)
    n = len(keys)
    when = pd.Timestamp("2023-01-01") + pd.to_timedelta(rng.integers(0, 400 * 24, n), unit="h")
    v = np.round(np.cumsum(rng.normal(0, 3, n)) + 100 + 0.05 * np.arange(n), 3)
    v[rng.random(n) < 0.03] = 0.0
    pdf = pd.DataFrame({"id": range(n), "k": keys, "at": when, "v": v})
    pdf.loc[5, "v"] = np.nan
    df = spark.createDataFrame(pdf[["id", "k", "at"]].assign(v=pdf["v"].where(pdf["v"].notna(), None).astype(object)), "id long, k long, at timestamp_ntz, v double")
    return pdf.dropna().sort_values(["k", "at", "id"]), df.repartition(5)


def _series(df, **kw):
    return ts.Series(df, "at", "v", ["id"], ["k"], block_size=400, **kw)


def _by_key(frame):
    return {r["k"]: r for r in frame.collect()}


def test_moving_average_gate_and_values(data):
    pdf, df = data
    got = {r["id"]: r for r in ts.moving_average(_series(df), (7, 30)).collect()}
    assert len(got) == len(pdf)
    for _, g in pdf.groupby("k"):
        want = g["v"].rolling(7, min_periods=1).mean()
        for i, w in zip(g["id"], want):
            assert got[i]["ma_7"] == (pytest.approx(w) if len(g) >= 7 else None)
            assert (got[i]["ma_30"] is None) == (len(g) < 30)


def test_growth_trend_drawdown_momentum(data):
    pdf, df = data
    growth, trend = _by_key(ts.growth(_series(df))), _by_key(ts.linear_trend(_series(df)))
    drop = _by_key(ts.max_drawdown(_series(df)))
    steps = {(r["k"], r["step"]): r["momentum"] for r in ts.momentum(_series(df)).collect()}
    for k, g in pdf.groupby("k"):
        v = g["v"].reset_index(drop=True)
        change = v.pct_change(fill_method=None).replace([np.inf, -np.inf], np.nan).dropna()
        if len(change):
            assert growth[k]["mean"] == pytest.approx(change.mean()) and growth[k]["min"] == pytest.approx(change.min())
        if len(v) >= 3:
            slope, start = np.polyfit(np.arange(len(v)), v, 1)
            assert trend[k]["slope"] == pytest.approx(slope) and trend[k]["intercept"] == pytest.approx(start)
            assert trend[k]["trend_direction"] == ("increasing" if slope > 0 else "decreasing")
        else:
            assert k not in trend
        peak = v.cummax()
        assert drop[k]["max_drawdown"] == pytest.approx(((v - peak) / peak).min())
        for p in (5, 10, 20):
            if len(v) >= max(10, p) and v.iloc[-p] != 0:
                assert steps[k, p] == pytest.approx((v.iloc[-1] - v.iloc[-p]) / v.iloc[-p])
            elif len(v) < max(10, p):
                assert (k, p) not in steps


def test_autocorrelation_and_seasonality(data):
    pdf, df = data
    auto = {(r["k"], r["lag"]): r["autocorr"] for r in ts.autocorrelation(_series(df)).collect()}
    phases = {(r["k"], r["period"], r["phase"]): r for r in ts.seasonal_profile(_series(df), (7,)).collect()}
    strength = {r["k"]: r["strength"] for r in ts.seasonal_strength(_series(df), (7,)).collect()}
    for k, g in pdf.groupby("k"):
        v = g["v"].reset_index(drop=True)
        lags = range(1, min(20, len(v) // 4) + 1) if len(v) >= 10 else []
        assert {lag for kk, lag in auto if kk == k} == set(lags)
        for lag in lags:
            assert auto[k, lag] == pytest.approx(v.autocorr(lag))
        if len(v) >= 14:
            stats = v.groupby(np.arange(len(v)) % 7).agg(["mean", "std", "count"])
            for p in range(7):
                assert phases[k, 7, p]["mean"] == pytest.approx(stats["mean"][p])
                assert phases[k, 7, p]["count"] == stats["count"][p]
            b, w = stats["mean"].var(), stats["std"].mean() ** 2
            assert strength[k] == pytest.approx(b / (b + w))
        else:
            assert k not in strength


def test_volatility_quantiles(data):
    pdf, df = data
    got = _by_key(ts.volatility(_series(df)))
    v = pdf[pdf["k"] == 0]["v"]
    r = v.pct_change(fill_method=None).replace([np.inf, -np.inf], np.nan).dropna()
    assert got[0]["volatility"] == pytest.approx(r.std()) and got[0]["value_at_risk_1pct"] == pytest.approx(r.quantile(0.01))
    assert got[0]["annualized_volatility"] == pytest.approx(r.std() * np.sqrt(252))


@pytest.mark.parametrize("n,rows", [(364, 0), (365, 0), (366, 1)])
def test_year_over_year_gate(spark, n, rows):
    df = spark.range(n).select("id", F.col("id").alias("at"), (F.col("id") + 1.0).alias("v"))
    out = ts.growth_yoy(ts.Series(df, "at", "v", ["id"]))
    assert out.count() == rows
    if rows:
        assert out.first()["current"] == pytest.approx(365.0)


def test_calendar_labels_survive_missing_days(spark):
    days = pd.date_range("2024-01-01", "2024-03-20")
    pdf = pd.DataFrame({"at": [d for d in days if d.dayofweek != 6 and d.dayofweek != 1]})
    pdf["v"] = pdf["at"].dt.dayofweek.astype(float)
    s = ts.Series(spark.createDataFrame(pdf), "at", "v")
    got = {r["label"]: r for r in ts.dow_profile(s).collect()}
    assert got["Sunday"]["count"] == 0 and got["Tuesday"]["mean"] is None
    assert got["Wednesday"]["mean"] == 2.0 and got["Saturday"]["mean"] == 5.0
    months = {r["label"]: r["count"] for r in ts.month_profile(s).collect()}
    assert len(months) == 12 and months["Aug"] == 0 and months["Jan"] > 0


@pytest.mark.parametrize(
    "hours,label", [(1, "hourly_or_less"), (2, "daily"), (25, "weekly"), (200, "monthly"), (24 * 90, "yearly"), (24 * 400, "irregular")]
)
def test_frequency_labels(spark, hours, label):
    at = pd.date_range("2001-01-01", periods=6, freq=f"{hours}h")
    df = spark.createDataFrame(pd.DataFrame({"at": at, "v": np.arange(6.0)}))
    assert ts.frequency(ts.Series(df, "at", "v")).first()["frequency"] == label


def test_single_point_frequency_is_unknown_and_day_range_ignores_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        pdf = pd.DataFrame({"k": [1, 2, 2], "at": pd.to_datetime(["2024-01-01", "2024-03-10", "2024-03-11"]), "v": [1.0] * 3})
        s = ts.Series(spark.createDataFrame(pdf, "k long, at timestamp_ntz, v double"), "at", "v", keys=["k"])
        assert _by_key(ts.frequency(s))[1]["frequency"] == "unknown"
        assert _by_key(ts.basic_metrics(s))[2]["range_days"] == 1  # 23 hours of elapsed time there
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_constant_series_is_stable(spark):
    df = spark.range(12).select("id", F.col("id").alias("at"), F.lit(4.0).alias("v"))
    trend = ts.linear_trend(ts.Series(df, "at", "v", ["id"])).first()
    assert (trend["trend_direction"], trend["trend_strength"], trend["p_value"]) == ("stable", 0.0, 1.0)
    assert ts.autocorrelation(ts.Series(df, "at", "v", ["id"])).count() == 0
    assert [r["level"] for r in ts.minmax_level(ts.Series(df, "at", "v", ["id"])).collect()] == [None] * 12


def test_student_tail():
    assert student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert student_two_sided(12.7062047, 1) == pytest.approx(0.05, abs=1e-8)
