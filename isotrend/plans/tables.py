"""The tables and joined views the queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.operators.joins import left_join

# The last year of the order dates is partial.
PARTIAL_YEAR = 2001

# SQL text of the same views.
NATION_ORDERS = """nation_orders AS (
  SELECT n_name AS nation, o_totalprice, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS yr,
         CAST(month(o_orderdate) AS INTEGER) AS mon
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
MONTH_NAMES = ("['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', "
               "'September', 'October', 'November', 'December']")


def registrar():
    """Two empty tables, queries and their SQL by name, and the decorator that fills them."""
    queries, oracles = {}, {}

    def register(name: str, sql: str):
        def add(query):
            queries[name], oracles[name] = query, sql
            return query
        return add

    return queries, oracles, register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nation_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the nation of their customer: the analogue of readings by area and date.

    Two plain left joins: a later filter on the date goes below them, to the one scan of orders.
    """
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    keyed = left_join(orders, customer, "o_custkey", null_safe=False)
    return left_join(keyed, nation, {"c_nationkey": "n_nationkey"}, null_safe=False).drop("o_custkey", "c_nationkey")


def year_of(column: str = "o_orderdate") -> Column:
    return F.year(column)


def month_of(column: str = "o_orderdate") -> Column:
    return F.month(column)


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    """Round measures so that two engines print the same digits."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})
