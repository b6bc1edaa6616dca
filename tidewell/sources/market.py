"""Daily bars and metrics as (series, d, ...) from the tables of orders and line items.

A series is an order priority; a bar's open and close are the first and last order of the day, its volume their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(ticks: DataFrame, price: str, order: str) -> DataFrame:
    """Daily bars of ticks (series, d, price, order)."""
    return ticks.groupBy("series", "d").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.count("*").cast("double").alias("vol"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderkey")
    return bars_of(orders, "o_totalprice", "o_orderkey")


def metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, d, value: the day's mean discount of shipped items, on its own calendar."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("d"), "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("series", "d").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100).alias("value"))


#: The same in SQL, for the queries' oracles.
BARS_SQL = """bars AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS vol
  FROM orders GROUP BY ALL)"""
METRIC_SQL = """metric AS (
  SELECT o_orderpriority AS series, CAST(l_shipdate AS DATE) AS d, sum(round(l_discount * 100)::BIGINT) / count(*) / 100 AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


#: Days by which the orders' first ones reach August 2026, where the calendar of events begins.
AGENDA_DAYS = 11_535


def moved_days(spark: SparkSession, sf_dir: str, *by: int) -> DataFrame:
    """d: the orders' days, moved on by each of so many days."""
    day = F.explode(F.array(*[F.date_add(F.to_date("o_orderdate"), n) for n in by]))
    return table(spark, sf_dir, "orders").select(day.alias("d")).distinct()


def moved_days_sql(*by: int) -> str:
    return f"SELECT DISTINCT CAST(o_orderdate AS DATE) + unnest([{', '.join(map(str, by))}])::INTEGER AS d FROM orders"
