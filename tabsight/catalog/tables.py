"""Frames shared by several queries, with the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.catalog.registry import table

LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

# events with gaps: error rows have no value, most rows no props
GAPPY_SQL = """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
       CASE WHEN event_type IN ('error', 'view', 'click') THEN NULL ELSE props END AS props
FROM events"""


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.when(kind == "error", None).otherwise(F.col("value")).alias("value"),
        F.when(kind.isin("error", "view", "click"), None).otherwise(F.col("props")).alias("props"),
    )


# two measures per event, one of them heavy-tailed, both without the error rows
MEASURES_SQL = """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
       CASE WHEN event_type = 'error' THEN NULL ELSE value * value END AS value_sq
FROM events"""
MEASURES = ("value", "value_sq")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.when(ok, F.col("value")).alias("value"),
        F.when(ok, F.col("value") * F.col("value")).alias("value_sq"),
    )


# line items with derived amounts that depend strongly on each other
AMOUNTS_SQL = """
SELECT l_quantity, l_extendedprice, l_discount, l_tax,
       l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
       -l_extendedprice * l_tax AS tax_paid
FROM lineitem"""
AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "charge", "tax_paid")


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        *LINE_COLUMNS,
        (price * (1 - off)).alias("net"),
        (price * (1 - off) * (1 + tax)).alias("charge"),
        (-price * tax).alias("tax_paid"),
    )


# order value per day
DAILY_SQL = """
SELECT o_orderdate AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderdate"""


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


# one entity per part with outcome, utilization, risk and timeline measures from its line items
ENTITY_SQL = """
SELECT l_partkey AS part,
       round(avg(l_extendedprice) / 100000, 6) AS price_level,
       round(avg(l_quantity) / 50, 6) AS volume_level,
       round(avg(l_discount) * 10, 6) AS discount_use,
       round(avg(l_tax) * 10, 6) AS tax_use,
       round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS return_share,
       round(avg(CAST(l_linenumber AS DOUBLE)) * 20, 6) AS days
FROM lineitem GROUP BY l_partkey"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.round(F.avg("l_extendedprice") / 100000, 6).alias("price_level"),
        F.round(F.avg("l_quantity") / 50, 6).alias("volume_level"),
        F.round(F.avg("l_discount") * 10, 6).alias("discount_use"),
        F.round(F.avg("l_tax") * 10, 6).alias("tax_use"),
        F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("return_share"),
        F.round(F.avg(F.col("l_linenumber").cast("double")) * 20, 6).alias("days"),
    )
