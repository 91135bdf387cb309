"""Descriptive statistics, aggregations, correlations, outliers and distribution tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import long_sql, register, table
from tabsight.catalog.tables import (
    AMOUNTS, AMOUNTS_SQL, LINE_COLUMNS, MEASURES, MEASURES_SQL, amounts, measures,
)
from tabsight.functions.columns import rounded
from tabsight.operators import correlation, disttests, outliers, stats

_LINES = long_sql("lineitem", {c: c for c in LINE_COLUMNS})
_LINES_BY_FLAG = long_sql("lineitem", {c: c for c in LINE_COLUMNS}, "l_returnflag")


def _round_all(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", *LINE_COLUMNS)


# ---------------------------------------------------------------- descriptive statistics
@register(
    "describe_wide",
    f"""
    SELECT "column", count(*) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
           round(stddev_samp(value), 6) AS std, round(var_samp(value), 3) AS var, min(value) AS min, max(value) AS max
    FROM ({_LINES}) GROUP BY "column\"""",
)
def describe_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stats.describe(_lines(spark, sf_dir)).select("column", "count", "mean", "median", "std", "var", "min", "max")
    return _round_all(_round_all(wide, ("mean", "median", "std")), ("var",), 3)


@register(
    "describe_moments",
    f"""
    SELECT "column", round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis
    FROM ({_LINES} UNION ALL {long_sql('events', {'value': 'value'})}) GROUP BY "column\"""",
)
def describe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stats.describe(_lines(spark, sf_dir))
    events = stats.describe(table(spark, sf_dir, "events"), ["value"])
    return _round_all(lines.unionByName(events).select("column", "skewness", "kurtosis"), ("skewness", "kurtosis"), 5)


@register(
    "describe_quantiles",
    f"""
    SELECT "column", round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
           round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr
    FROM ({_LINES}) GROUP BY "column\"""",
)
def describe_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_all(stats.describe(_lines(spark, sf_dir)).select("column", "q25", "q75", "iqr"), ("q25", "q75", "iqr"))


@register(
    "describe_mode",
    f"""
    SELECT "column", value AS mode, n AS mode_count FROM (
      SELECT "column", value, count(*) AS n,
             row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rn
      FROM ({_LINES}) GROUP BY "column", value) WHERE rn = 1""",
)
def describe_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mode_by_column(_lines(spark, sf_dir), LINE_COLUMNS)


@register(
    "describe_long",
    f"""
    SELECT "column", stat, value FROM (
      SELECT "column", CAST(count(*) AS DOUBLE) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
             round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max
      FROM ({_LINES}) GROUP BY "column")
    UNPIVOT (value FOR stat IN (count, mean, median, std, min, max))""",
)
def describe_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stats.describe(_lines(spark, sf_dir))
    return _round_all(stats.long_form(wide, ["column"], ["count", "mean", "median", "std", "min", "max"]), ("value",))


@register(
    "describe_grouped",
    f"""
    WITH cells AS ({_LINES_BY_FLAG}),
    modes AS (SELECT l_returnflag, "column", value AS mode, n AS mode_count FROM (
        SELECT l_returnflag, "column", value, count(*) AS n,
               row_number() OVER (PARTITION BY l_returnflag, "column" ORDER BY count(*) DESC, value) AS rn
        FROM cells GROUP BY 1, 2, 3) WHERE rn = 1)
    SELECT c.l_returnflag, c."column", count(*) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
           round(stddev_samp(value), 6) AS std, round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis,
           round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
           any_value(mode) AS mode, any_value(mode_count) AS mode_count
    FROM cells c JOIN modes m ON c.l_returnflag = m.l_returnflag AND c."column" = m."column" GROUP BY 1, 2""",
)
def describe_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stats.describe(_lines(spark, sf_dir), keys=["l_returnflag"]).select(
        "l_returnflag", "column", "count", "mean", "median", "std", "skewness", "kurtosis", "q25", "q75", "mode", "mode_count"
    )
    return _round_all(_round_all(wide, ("mean", "median", "std", "q25", "q75")), ("skewness", "kurtosis"), 5)


# ---------------------------------------------------------------- aggregations
_AGG = """count(value) AS count, round(coalesce(sum(value), 0), 2) AS sum, round(avg(value), 6) AS mean,
          round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max"""
_QUANTILES = ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{int(q * 100)}" for q in stats.AGGREGATION_QUANTILES)
_METHODS = ("sum", "count", "mean", "median", "std", "min", "max")


def _shape(df: DataFrame) -> DataFrame:
    fine = [c for c in df.columns if c in ("mean", "median", "std") or c[:1] == "q"]
    return _round_all(_round_all(df, fine), ("sum",), 2)


@register("agg_global", f"SELECT \"column\", {_AGG} FROM ({_LINES}) GROUP BY \"column\"")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(stats.aggregate(_lines(spark, sf_dir), methods=_METHODS))


@register("agg_global_quantiles", f"SELECT \"column\", {_QUANTILES} FROM ({_LINES}) GROUP BY \"column\"")
def agg_global_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(stats.aggregate(_lines(spark, sf_dir), methods=["quantile"]))


@register("agg_grouped", f"SELECT l_returnflag, \"column\", {_AGG} FROM ({_LINES_BY_FLAG}) GROUP BY 1, 2")
def agg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(stats.aggregate(_lines(spark, sf_dir), methods=_METHODS, group_by="l_returnflag"))


@register("agg_grouped_quantiles", f"SELECT l_returnflag, \"column\", {_QUANTILES} FROM ({_LINES_BY_FLAG}) GROUP BY 1, 2")
def agg_grouped_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(stats.aggregate(_lines(spark, sf_dir), methods=["quantile"], group_by="l_returnflag"))


_GAPPY = long_sql(f"({MEASURES_SQL})", {c: c for c in MEASURES}, "event_type")


@register(
    "agg_grouped_gaps",
    f"""
    SELECT k.event_type, k."column", count(c.value) AS count, round(coalesce(sum(c.value), 0), 2) AS sum,
           round(avg(c.value), 6) AS mean, min(c.value) AS min, max(c.value) AS max
    FROM (SELECT DISTINCT event_type, "column" FROM events, (SELECT unnest(['value', 'value_sq']) AS "column")) k
    LEFT JOIN ({_GAPPY}) c ON k.event_type = c.event_type AND k."column" = c."column" GROUP BY 1, 2""",
)
def agg_grouped_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group has no values at all: its count and sum are 0."""
    methods = ["count", "sum", "mean", "min", "max"]
    return _shape(stats.aggregate(measures(spark, sf_dir), MEASURES, methods, group_by="event_type"))


# ---------------------------------------------------------------- correlations
def _pairs_sql(source: str, columns, corr) -> str:
    return " UNION ALL ".join(corr(source, a, b) for a, b in combinations(columns, 2))


def _pearson_one(source: str, a: str, b: str) -> str:
    return f"SELECT 'pearson' AS method, '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 6) AS corr FROM {source}"


def _spearman_one(source: str, a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return (
        f"SELECT 'spearman' AS method, '{a}' AS col1, '{b}' AS col2, round(corr(ra, rb), 6) AS corr FROM "
        f"(SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    )


def _kendall_one(source: str, a: str, b: str) -> str:
    """Tau-b over all rows, from the distinct value pairs with their counts."""
    return f"""
    SELECT 'kendall' AS method, '{a}' AS col1, '{b}' AS col2, round((con - dis) / sqrt((n0 - n1) * (n0 - n2)), 6) AS corr FROM (
      SELECT (SELECT sum(p.w * q.w) FROM c_{a}_{b} p JOIN c_{a}_{b} q ON p.x < q.x AND p.y < q.y) AS con,
             (SELECT sum(p.w * q.w) FROM c_{a}_{b} p JOIN c_{a}_{b} q ON p.x < q.x AND p.y > q.y) AS dis,
             (SELECT sum(w) * (sum(w) - 1) / 2 FROM c_{a}_{b}) AS n0,
             (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(w) AS t FROM c_{a}_{b} GROUP BY x)) AS n1,
             (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(w) AS t FROM c_{a}_{b} GROUP BY y)) AS n2)"""


def _kendall_sql(source: str, columns) -> str:
    cells = ", ".join(
        f"c_{a}_{b} AS (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS w FROM {source} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"
        for a, b in combinations(columns, 2)
    )
    return f"WITH {cells} " + _pairs_sql(source, columns, _kendall_one)


def _corr(df: DataFrame) -> DataFrame:
    return df.withColumn("corr", rounded("corr"))


@register("corr_pearson", _pairs_sql(f"({AMOUNTS_SQL})", AMOUNTS, _pearson_one))
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(correlation.correlations(amounts(spark, sf_dir), methods=["pearson"]))


@register("corr_spearman", _pairs_sql("lineitem", LINE_COLUMNS, _spearman_one))
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(correlation.correlations(_lines(spark, sf_dir), methods=["spearman"]))


_GAP_COLUMNS = ("value", "user_id", "event_id")
_GAP_SQL = """(SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
                CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS user_id, event_id FROM events)"""


def _gap_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind != "error", F.col("value")).alias("value"), F.when(kind != "view", F.col("user_id")).alias("user_id"), "event_id"
    )


@register(
    "corr_pearson_gaps",
    " UNION ALL ".join(
        f"SELECT 'pearson' AS method, '{a}' AS col1, '{b}' AS col2, "
        f"round(corr({a}, {b}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL), 6) AS corr FROM {_GAP_SQL}"
        for a, b in combinations(_GAP_COLUMNS, 2)
    ),
)
def corr_pearson_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(correlation.correlations(_gap_frame(spark, sf_dir), _GAP_COLUMNS, ["pearson"]))


@register("corr_spearman_gaps", _pairs_sql(_GAP_SQL, _GAP_COLUMNS, _spearman_one))
def corr_spearman_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(correlation.correlations(_gap_frame(spark, sf_dir), _GAP_COLUMNS, ["spearman"]))


_KENDALL_COLUMNS = ("l_quantity", "l_discount", "l_tax")


@register("corr_kendall", _kendall_sql("lineitem", _KENDALL_COLUMNS))
def corr_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(correlation.correlations(_lines(spark, sf_dir), _KENDALL_COLUMNS, ["kendall"]))


def _kendall_grid(source: str, a: str, b: str, few: str) -> str:
    """Tau-b where ``few`` has few values: discordant and concordant weight of each cell from two running sums over a grid."""
    many = b if few == a else a
    return f"""
    SELECT 'kendall' AS method, '{a}' AS col1, '{b}' AS col2, round((con - dis) / sqrt((n0 - n1) * (n0 - n2)), 6) AS corr FROM (
      WITH c AS (SELECT {few} AS x, {many} AS y, CAST(count(*) AS DOUBLE) AS w FROM {source}
                 WHERE {few} IS NOT NULL AND {many} IS NOT NULL GROUP BY 1, 2),
      grid AS (SELECT x, y, coalesce(w, 0) AS w FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)),
      up AS (SELECT x, y, w, sum(w) OVER (PARTITION BY x ORDER BY y) AS below, sum(w) OVER (PARTITION BY x) AS all_x FROM grid),
      met AS (SELECT w, sum(below - w) OVER (PARTITION BY y ORDER BY x) - (below - w) AS less,
                     sum(all_x - below) OVER (PARTITION BY y ORDER BY x) - (all_x - below) AS more FROM up)
      SELECT (SELECT sum(w * less) FROM met) AS con, (SELECT sum(w * more) FROM met) AS dis,
             (SELECT sum(w) * (sum(w) - 1) / 2 FROM c) AS n0,
             (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(w) AS t FROM c GROUP BY x)) AS n1,
             (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(w) AS t FROM c GROUP BY y)) AS n2)"""


@register(
    "corr_kendall_all",
    " UNION ALL ".join(
        _kendall_grid("lineitem", a, b, b if a == "l_extendedprice" else a) for a, b in combinations(LINE_COLUMNS, 2)
    ),
)
def corr_kendall_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the line items, that of many values too, whose pairs are counted block by block."""
    return _corr(correlation.correlations(_lines(spark, sf_dir), LINE_COLUMNS, ["kendall"]))


@register("corr_kendall_parts", _kendall_sql("part", ("p_size", "p_retailprice")))
def corr_kendall_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(correlation.correlations(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["kendall"]))


@register(
    "corr_matrix",
    f"""
    WITH p AS ({_pairs_sql('lineitem', LINE_COLUMNS, _pearson_one)})
    SELECT method, col1, col2, corr FROM p UNION ALL SELECT method, col2, col1, corr FROM p
    UNION ALL SELECT 'pearson', c, c, 1.0::DOUBLE FROM (SELECT unnest({list(LINE_COLUMNS)}) AS c)""",
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = correlation.correlations(_lines(spark, sf_dir), methods=["pearson"])
    return _corr(correlation.matrix(pairs, LINE_COLUMNS))


@register(
    "strong_pairs",
    f"SELECT * FROM ({_pairs_sql(f'({AMOUNTS_SQL})', AMOUNTS, _pearson_one)}) WHERE abs(corr) > 0.7",
)
def strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.strong_pairs(_corr(correlation.correlations(amounts(spark, sf_dir), methods=["pearson"])))


@register(
    "corr_bucket",
    f"""
    SELECT *, CASE WHEN corr > 0.7 THEN '++' WHEN corr > 0.3 THEN '+' WHEN corr < -0.7 THEN '--'
                   WHEN corr < -0.3 THEN '-' ELSE '0' END AS bucket
    FROM ({_pairs_sql(f'({AMOUNTS_SQL})', AMOUNTS, _pearson_one)})""",
)
def corr_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.bucket(_corr(correlation.correlations(amounts(spark, sf_dir), methods=["pearson"])))


# ---------------------------------------------------------------- outliers
_M = f"({MEASURES_SQL})"


def flags_sql(column: str, method: str) -> str:
    """Flagged rows of one column by one threshold method."""
    test = {
        "iqr": f"x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)",
        "zscore": "abs((x - mean) / std) > 3.0",
        "modified_zscore": "mad > 0 AND abs(0.6745::DOUBLE * (x - med) / mad) > 3.5",
        "percentile": "x < p05 OR x > p95",
    }[method]
    return f"""
    SELECT event_id, '{method}' AS method, '{column}' AS "column", x AS value FROM (
      SELECT event_id, {column} AS x FROM {_M} WHERE {column} IS NOT NULL) d,
     (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3, avg({column}) AS mean,
             stddev_pop({column}) AS std, median({column}) AS med, mad({column}) AS mad,
             quantile_cont({column}, 0.05) AS p05, quantile_cont({column}, 0.95) AS p95 FROM {_M}) b
    WHERE {test}"""


ALL_FLAGS_SQL = " UNION ALL ".join(flags_sql(c, m) for c in MEASURES for m in outliers.THRESHOLD_METHODS)


def threshold_flags(spark: SparkSession, sf_dir: str, *methods: str) -> DataFrame:
    return outliers.threshold_flags(measures(spark, sf_dir), ["event_id"], MEASURES, methods or outliers.THRESHOLD_METHODS)


def _register_flags(name: str, method: str) -> None:
    @register(name, " UNION ALL ".join(flags_sql(c, method) for c in MEASURES))
    def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
        return threshold_flags(spark, sf_dir, method)


for _name, _method in (
    ("outliers_iqr", "iqr"), ("outliers_zscore", "zscore"), ("outliers_modz", "modified_zscore"),
    ("outliers_percentile", "percentile"),
):
    _register_flags(_name, _method)


@register("outliers_iforest")
def outliers_iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect(measures(spark, sf_dir), ["event_id"], ["value"], ["isolation_forest"])


@register("outliers_lof")
def outliers_lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect(measures(spark, sf_dir), ["event_id"], ["value"], ["lof"])


SUMMARY_SQL = f"""
    SELECT g.method, g."column", n, coalesce(c.count, 0) AS count, round(coalesce(c.count, 0) * 100.0::DOUBLE / n, 6) AS percent
    FROM (SELECT unnest({list(outliers.THRESHOLD_METHODS)}) AS method, 'value' AS "column", count(value) AS n FROM {_M}
          UNION ALL SELECT unnest({list(outliers.THRESHOLD_METHODS)}), 'value_sq', count(value_sq) FROM {_M}) g
    LEFT JOIN (SELECT method, "column", count(*) AS count FROM ({ALL_FLAGS_SQL}) GROUP BY 1, 2) c
      ON g.method = c.method AND g."column" = c."column\""""


def outlier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = outliers.method_grid(measures(spark, sf_dir), MEASURES, outliers.THRESHOLD_METHODS)
    return outliers.summarize(threshold_flags(spark, sf_dir), grid)


@register("outlier_counts", SUMMARY_SQL)
def outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_summary(spark, sf_dir).withColumn("percent", rounded("percent"))


@register(
    "outlier_methods",
    f"""
    SELECT method, CAST(sum(count) AS BIGINT) AS total_outliers, count(*) AS columns_processed,
           round(avg(percent), 5) AS avg_percentage FROM ({SUMMARY_SQL}) GROUP BY method""",
)
def outlier_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_all(outliers.compare_methods(outlier_summary(spark, sf_dir)), ("avg_percentage",), 5)


@register(
    "outlier_consensus",
    f"""
    SELECT "column", event_id, count(DISTINCT method) AS agreement FROM ({ALL_FLAGS_SQL})
    GROUP BY 1, 2 HAVING count(DISTINCT method) >= 2""",
)
def outlier_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.consensus(threshold_flags(spark, sf_dir), ["event_id"])


@register(
    "outlier_top_columns",
    f"SELECT \"column\", count(*) AS flags FROM ({ALL_FLAGS_SQL}) GROUP BY 1 ORDER BY flags DESC, \"column\" LIMIT 10",
)
def outlier_top_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.top_columns(threshold_flags(spark, sf_dir))


# ---------------------------------------------------------------- distribution tests
def _double_factorials(n: int) -> list[float]:
    """1, 3, 15, …: products of the first odd numbers."""
    out = [1.0]
    for k in range(1, n):
        out.append(out[-1] * (2 * k + 1))
    return out


# the normal distribution function by its series of odd powers, all of one sign; 0 or 1 beyond six deviations
_NORMAL_CDF_SQL = (
    "CASE WHEN z > 6 THEN 1 WHEN z < -6 THEN 0 ELSE 0.5::DOUBLE + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum("
    f"[pow(z, 2 * i - 1) / f[i] FOR i IN range(1, 91)]) END"
)


def _ks_sql(keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys}" if keys else ""
    return f"""
    SELECT {lead}'value' AS "column", round(max(greatest(through / n - cdf, cdf - before / n)), 6) AS statistic FROM (
      SELECT {lead}n, rank() OVER ({over} ORDER BY value) - 1 AS before,
             rank() OVER ({over} ORDER BY value) - 1 + count(*) OVER (PARTITION BY {lead}value) AS through, {_NORMAL_CDF_SQL} AS cdf
      FROM (SELECT {lead}value, count(*) OVER ({over}) AS n, {[f"{v:.17e}" for v in _double_factorials(90)]}::DOUBLE[] AS f,
                   (value - avg(value) OVER ({over})) / stddev_samp(value) OVER ({over}) AS z FROM events WHERE value IS NOT NULL))
    WHERE n >= {disttests.MIN_ROWS} GROUP BY ALL"""


@register("ks_normal", _ks_sql())
def ks_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = disttests.ks_normal(table(spark, sf_dir, "events"), ["value"])
    return tested.select("column", rounded("statistic").alias("statistic"))


@register("ks_normal_by_group", _ks_sql("event_type"))
def ks_normal_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = disttests.ks_normal(table(spark, sf_dir, "events"), ["value"], ["event_type"])
    return tested.select("event_type", "column", rounded("statistic").alias("statistic"))


@register("ks_normal_p_value")
def ks_normal_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the p-value, whose distribution SQL cannot express."""
    return disttests.ks_normal(table(spark, sf_dir, "events"), ["value"], ["event_type"])


_DAGOSTINO_SQL = """
WITH m AS (
  SELECT event_type, 'value' AS "column", count(*) AS c, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mu FROM events GROUP BY 1),
p AS (
  SELECT e.event_type, any_value(m."column") AS "column", any_value(c) AS c, any_value(n) AS n,
         avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4
  FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1),
g AS (SELECT *, m3 / m2 ** 1.5::DOUBLE AS g1, m4 / (m2 * m2) AS b2 FROM p WHERE c >= 20),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
    (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM g),
t AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM s),
z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1,
    (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM t)
SELECT event_type, "column", c AS n, round(z1 * z1 + z2 * z2, 4) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value FROM z"""


@register("dagostino", _DAGOSTINO_SQL)
def dagostino(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = disttests.dagostino(table(spark, sf_dir, "events"), ["value"], ["event_type"])
    return _round_all(_round_all(tested, ("statistic",), 4), ("p_value",))


@register("shapiro_by_group")
def shapiro_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disttests.shapiro_by_group(table(spark, sf_dir, "events"), ["value"], ["user_id"])
