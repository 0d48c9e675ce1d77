"""Relational queries on the star schema and on events: what every part of the engine composes. Event windows are an extension of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.sources.tables import table


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    price, off = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(price), 2).alias("base"), F.round(F.sum(price * (1 - off)), 2).alias("net"))


def customer_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by nation: a star join, small sides broadcast by Spark where their size allows."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))), 2).alias("revenue"))


def orders_without_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = [pricing_summary, customer_revenue, orders_without_lines, hourly_events]

ORACLES = {
    "pricing_summary": "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice::DOUBLE), 2) AS base, round(sum(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE)), 2) AS net FROM lineitem GROUP BY l_returnflag",
    "customer_revenue": "SELECT n_name, round(sum(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "orders_without_lines": "SELECT count(*) AS n FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey",
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
