"""Feature importance: how much of each column's information the other columns carry.

One scan turns every row into the bins of its columns and counts the pairs of bins of all pairs of
columns; partial counts in the scan leave at most bins x bins rows for each pair and task.  The
mutual information, entropies and ranks come from these joint histograms alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabsight.functions.columns import number

BINS = 16


def _kinds(df: DataFrame, columns: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """Numeric columns, and text or boolean ones, among the given (by default all)."""
    wanted = set(df.columns if columns is None else columns)
    fields = [f for f in df.schema.fields if f.name in wanted]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def binned(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """(column names…): every value as the name of its bin, null for a missing value.

    Numbers fall into ``bins`` of equal width between the least and the greatest finite value (an infinite value counts as
    missing); texts and booleans are their own bins.  A column with one value has one bin.
    """
    numeric, other = _kinds(df, columns)
    cells: list[Column] = []
    if numeric:
        finite = df.select(*[F.when(F.abs(number(df, c)) != float("inf"), number(df, c)).alias(f"_{i}") for i, c in enumerate(numeric)])
        ends = finite.agg(*[f(f"_{i}").alias(f"{n}{i}") for i in range(len(numeric)) for n, f in (("a", F.min), ("b", F.max))]).first()
        for i, c in enumerate(numeric):
            low, high, x = ends[f"a{i}"], ends[f"b{i}"], number(df, c)
            if low is None:
                cells.append(F.lit(None).cast("string").alias(c))
                continue
            at = F.floor((x - low) / (high - low) * bins) if high > low else F.lit(0).cast("bigint")
            cells.append(F.when(F.abs(x) != float("inf"), F.least(at, F.lit(bins - 1)).cast("string")).alias(c))
    return df.select(*cells, *[F.col(f"`{c}`").cast("string").alias(c) for c in other])


def joint_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """(col1, col2, bin1, bin2, n): counts of all pairs of bins, over the rows that have both values."""
    cells = binned(df, columns, bins)
    pairs = [
        F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"`{a}`").alias("bin1"), F.col(f"`{b}`").alias("bin2"))
        for a, b in combinations(sorted(cells.columns), 2)
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, bin1 string, bin2 string, n bigint")
    rows = cells.select(F.inline(F.array(*pairs))).filter(F.col("bin1").isNotNull() & F.col("bin2").isNotNull())
    return rows.groupBy("col1", "col2", "bin1", "bin2").agg(F.count("*").alias("n"))


def mutual_information(joint: DataFrame) -> DataFrame:
    """(col1, col2, n, bins1, bins2, mi, entropy1, entropy2) in nats, from a joint histogram."""
    pair = ["col1", "col2"]
    sides = [joint.groupBy(*pair, f"bin{i}").agg(F.sum("n").alias(f"n{i}")) for i in (1, 2)]
    totals = joint.groupBy(*pair).agg(F.sum("n").alias("total"))
    # entropies sum over the bins of one side, the joint part over pairs of bins: mi = entropy1 + entropy2 - joint entropy
    part = lambda n: F.sum(-F.col(n) / F.col("total") * F.log(F.col(n) / F.col("total")))
    out = totals
    for i, side in enumerate(sides, 1):
        known = side.join(totals, pair).groupBy(*pair).agg(part(f"n{i}").alias(f"entropy{i}"), F.count("*").alias(f"bins{i}"))
        out = out.join(known, pair)
    both = joint.join(totals, pair).groupBy(*pair).agg(part("n").alias("both"))
    mi = F.greatest(F.col("entropy1") + F.col("entropy2") - F.col("both"), F.lit(0.0)).alias("mi")
    return out.join(both, pair).select(*pair, F.col("total").alias("n"), "bins1", "bins2", mi, "entropy1", "entropy2")


def feature_importance(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """(target, feature, n, mi, importance, rank) for all ordered pairs of columns.

    ``mi`` is less the bias that independent columns with as many bins would show, (bins1 - 1)(bins2 - 1) / 2n, and at least 0;
    ``importance`` is its share of the target's entropy (0 for a constant target), ``rank`` counts from the most
    important feature of a target, ties by name.  Pairs without a row that has both values are left out.
    """
    found = mutual_information(joint_histogram(df, columns, bins))
    mi = F.greatest(F.col("mi") - (F.col("bins1") - 1) * (F.col("bins2") - 1) / (2 * F.col("n")), F.lit(0.0))
    found = found.withColumn("mi", mi)

    def side(target: str, feature: str, entropy: str) -> Column:
        share = F.when(F.col(entropy) > 1e-12, F.least(F.col("mi") / F.col(entropy), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.struct(F.col(target).alias("target"), F.col(feature).alias("feature"), F.col("n"), F.col("mi"), share.alias("importance"))

    rows = found.select(F.inline(F.array(side("col1", "col2", "entropy1"), side("col2", "col1", "entropy2"))))
    # ties by name, also between shares that differ by the order of summing
    order = W.partitionBy("target").orderBy(F.round("importance", 9).desc(), "feature")
    return rows.withColumn("rank", F.row_number().over(order))


def importance_findings(importance: DataFrame) -> DataFrame:
    """(target, finding): the most significant predictor of each target that has one."""
    top = importance.filter((F.col("rank") == 1) & (F.col("importance") > 0))
    # Fixed value: the wording.
    return top.select("target", F.concat("feature", F.lit(" identified as most significant predictor")).alias("finding"))
