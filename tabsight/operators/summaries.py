"""Profiles that are stored and merged: statistics of a table from states of its parts, without reading rows again.

A state is one small table.  Its rows without a ``power`` hold, for each (parts…, column), counts, extremes, a
quantile sketch and a distinct-count sketch.  The others hold exact sums: every double x is m * 2^e with a
whole m, so the m of one band of exponents add up as whole numbers.  Such sums depend neither on the order of
rows nor on partitioning nor on the number of merges: a merged state has the bits of one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsight.functions.columns import number, numeric_columns

KLL_K = 400
RANK_ERROR = 0.01  # a quantile's rank is this close, as a share of the rows, with 99 % confidence
HLL_K = 14
DISTINCT_ERROR = 0.03  # more than three standard deviations of the distinct count
BAND = 8  # exponents in one band: they and the 53 bits of a double fit a bigint
POWERS = ("x", "xx", "xxx", "xxxx")
CROSS = ("n", "x", "y", "xx", "yy", "xy")
OWN = ("column", "other", "power", "band", "digits", "count", "infinite", "min", "max", "kll", "hll")


def _scaled(value: Column, power: Column) -> Column:
    """value * 2^power in two steps, as one factor alone may leave the range of doubles."""
    half = F.floor(power / 2)
    return value * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (power - half).cast("double"))


def _exact_sums(terms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope…, band, digits): the sum of ``term`` is that of digits * 2^(8 band - 53); an infinite term has no band.

    The logarithm may put a value at the edge of a band into the next one; its digits are whole numbers in both.
    """
    term = F.col("term")
    inside = F.abs(term) < F.lit(float("inf"))
    banded = terms.withColumn("band", F.when(term == 0, F.lit(0)).when(inside, F.floor(F.log2(F.abs(term)) / BAND)).cast("int"))
    digits = F.when(inside, _scaled(term, 53 - F.col("band") * BAND)).cast("long").cast("decimal(28,0)")
    return banded.withColumn("digits", digits).groupBy(*scope, "band").agg(F.sum("digits").alias("digits"))


def _terms(rows: DataFrame, parts: Sequence[str], products: Iterable[tuple[str, Column]]) -> DataFrame:
    """(parts…, column, other, power, term): the products of each row's values."""
    cells = F.array(*[F.struct(F.lit(p).alias("power"), t.alias("term")) for p, t in products])
    return rows.select(*parts, "column", "other", F.inline(cells))


def _finite(df: DataFrame, column: str) -> Column:
    """The value as a double with one zero; null where it is missing or infinite."""
    value = number(df, column)
    return F.when(F.abs(value) < F.lit(float("inf")), value + F.lit(0.0))


def summarize(df: DataFrame, columns: Sequence[str] | None = None, parts: Sequence[str] = (), pairs: bool = True) -> DataFrame:
    """The state of the numeric columns for each combination of ``parts``, from two scans (three with ``pairs``).

    Cells are melted and partially aggregated in the scan stage, so a part that holds most rows is one row per
    task, column and band in the shuffle.  Null and NaN are missing; infinite values are counted in
    ``infinite`` and take part in nothing else.  A null part is a part of its own.  A column without values has
    no rows, an empty table no state.  ``pairs`` adds what correlations need: sums over the rows where both
    columns have a value, so its size and cost grow with the square of the number of columns.
    """
    parts = list(parts)
    taken = sorted({*OWN, "batch", "term", "finite", "value"} & set(parts))
    if taken:
        raise ValueError(f"parts carry names of the state: {taken}")
    names = [c for c in numeric_columns(df, columns) if c not in parts]
    if not names:
        raise ValueError("no numeric column to summarize")
    finite = {c: _finite(df, c) for c in names}
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), number(df, c).alias("value"), finite[c].alias("finite")) for c in names
    ])
    values = (
        df.select(*parts, F.inline(cells)).filter(F.col("value").isNotNull())
        .groupBy(*parts, "column")
        .agg(
            F.count("finite").alias("count"), (F.count("*") - F.count("finite")).alias("infinite"),
            F.min("finite").alias("min"), F.max("finite").alias("max"),
            F.kll_sketch_agg_double("finite", F.lit(KLL_K)).alias("kll"),
            F.hll_sketch_agg(F.when(F.col("finite").isNotNull(), F.xxhash64("finite")), F.lit(HLL_K)).alias("hll"),
        )
    )
    # values first, their products from plain columns after that: one array of all products outgrows what the JVM compiles
    single = F.array(*[F.struct(F.lit(c).alias("column"), finite[c].alias("finite")) for c in names])
    x = F.col("finite")
    rows = df.select(*parts, F.inline(single)).filter(x.isNotNull()).withColumn("other", F.lit(""))
    long = _terms(rows, parts, zip(POWERS, (x, x * x, x * x * x, x * x * x * x), strict=True))
    if pairs and len(names) > 1:
        double = F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(d).alias("other"), finite[c].alias("finite"), finite[d].alias("value"))
            for c, d in combinations(names, 2)
        ])
        y = F.col("value")
        rows = df.select(*parts, F.inline(double)).filter(x.isNotNull() & y.isNotNull())
        long = long.unionByName(_terms(rows, parts, zip(CROSS, (F.lit(1.0), x, y, x * x, y * y, x * y), strict=True)))
    sums = _exact_sums(long, [*parts, "column", "other", "power"])
    return values.unionByName(sums, allowMissingColumns=True).select(*parts, *OWN)


def merge(state: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """The state of coarser parts: rows that agree in ``parts`` become one.  No row of the table is read."""
    parts = list(parts)
    values = (
        state.filter(F.col("power").isNull())
        .groupBy(*parts, "column")
        .agg(
            F.sum("count").alias("count"), F.sum("infinite").alias("infinite"), F.min("min").alias("min"), F.max("max").alias("max"),
            F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll").alias("hll"),
        )
    )
    sums = state.filter(F.col("power").isNotNull()).groupBy(*parts, "column", "other", "power", "band").agg(F.sum("digits").alias("digits"))
    return values.unionByName(sums, allowMissingColumns=True).select(*parts, *OWN)


def store(state: DataFrame, path: str, batch: str) -> None:
    """Keep the state of one batch of rows below ``path``; a batch of the same name is replaced, so a repeated run counts once."""
    if not batch or "/" in batch:
        raise ValueError("a batch needs a name without slashes")
    state.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, parts: Sequence[str] = ()) -> DataFrame:
    """One state of all batches below ``path``."""
    kept = spark.read.parquet(path).drop("batch")
    return merge(kept, parts)


def _totals(state: DataFrame, scope: Sequence[str], powers: Sequence[str]) -> DataFrame:
    """(scope…, one column per power): the sums as doubles; null where a term left the range of doubles."""
    digits = F.sort_array(F.collect_list(F.struct("band", "digits")), asc=False)  # at most some 270 bands
    total = F.aggregate(
        digits, F.lit(0.0), lambda acc, d: acc + _scaled(d["digits"].cast("double"), d["band"] * BAND - 53)
    )
    whole = F.when(~F.bool_or(F.col("digits").isNull()), total)
    sums = state.groupBy(*scope, "power").agg(whole.alias("total"))
    return sums.groupBy(*scope).agg(*[F.max(F.when(F.col("power") == p, F.col("total"))).alias(p) for p in powers])


def describe_state(state: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """(parts…, column, count, infinite, distinct, mean, std, var, min, max, skewness, kurtosis, q25, median, q75).

    Moments come from exact sums of powers and lose digits only where the mean is many standard deviations
    from zero; quantiles are values of the table whose rank is off by at most ``RANK_ERROR`` of the rows.
    ``state`` has one row per part and column, as ``summarize``, ``merge`` and ``stored`` return it.
    """
    scope = [*parts, "column"]
    values = state.filter(F.col("power").isNull())
    sums = _totals(state.filter((F.col("power").isNotNull()) & (F.col("other") == "")), scope, POWERS)
    same = [values[c].eqNullSafe(sums[c]) for c in scope]
    joined = values.join(sums, same, "left").select(*[values[c] for c in scope], *OWN[5:], *POWERS)
    n = F.col("count").cast("double")
    mean = F.try_divide(F.col("x"), n)
    spread = F.try_divide(F.col("xx"), n) - mean * mean
    m2 = F.when(spread > 0, spread).when(spread <= 0, F.lit(0.0))  # null where a square left the range
    m3 = F.try_divide(F.col("xxx"), n) - 3 * mean * F.try_divide(F.col("xx"), n) + 2 * mean * mean * mean
    m4 = (
        F.try_divide(F.col("xxxx"), n) - 4 * mean * F.try_divide(F.col("xxx"), n)
        + 6 * mean * mean * F.try_divide(F.col("xx"), n) - 3 * mean * mean * mean * mean
    )
    varied = F.col("min") < F.col("max")
    var = F.when(n >= 2, F.when(~varied, F.lit(0.0)).otherwise(m2 * n / (n - 1)))
    skew = F.when((n >= 3) & varied, F.try_divide(m3, m2 * F.sqrt(m2)) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & varied, ((n + 1) * (F.try_divide(m4, m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    ranks = F.when(n > 0, F.kll_sketch_get_quantile_double("kll", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return joined.select(
        *scope, "count", "infinite", F.hll_sketch_estimate("hll").alias("distinct"), mean.alias("mean"), F.sqrt(var).alias("std"),
        var.alias("var"), "min", "max", skew.alias("skewness"), kurt.alias("kurtosis"),
        ranks[0].alias("q25"), ranks[1].alias("median"), ranks[2].alias("q75"),
    )


def correlate_state(state: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """(parts…, column, other, n, pearson) of all pairs that share rows; null without variation."""
    scope = [*parts, "column", "other"]
    t = _totals(state.filter(F.col("other") != ""), scope, CROSS)
    n = F.col("n")
    sxx, syy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    sxy = n * F.col("xy") - F.col("x") * F.col("y")
    pearson = F.when((sxx > 0) & (syy > 0), sxy / (F.sqrt(sxx) * F.sqrt(syy)))
    bounded = F.when(pearson.isNotNull(), F.greatest(F.least(pearson, F.lit(1.0)), F.lit(-1.0)))
    return t.select(*scope, n.cast("long").alias("n"), bounded.alias("pearson"))
