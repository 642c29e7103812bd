"""Reading untidy text and keyed files, writing and reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.functions.calendar import split_year_month
from isotrend.operators.change import entity_year_mean
from isotrend.operators.moment_store import (add_batch, period_change_from_moments, read_store, trend_from_moments,
                                             yearly_from_moments)
from isotrend.plans.change_queries import ORACLES as CHANGE_SQL
from isotrend.plans.change_queries import PRICE_BREAKS, PRICE_LABELS
from isotrend.plans.tables import PARTIAL_YEAR, nation_orders, registrar, rounded, table, year_of
from isotrend.plans.trend_queries import ORACLES as TREND_SQL
from isotrend.session import scratch_path
from isotrend.sources.readers import (YEAR_MONTH, drop_row_number, header_names, read_keyed_files, read_table)
from isotrend.sources.writers import write_bucketed, write_table

QUERIES, ORACLES, register = registrar()


@register("tables_by_file", """SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(balance), 6) AS balance FROM (
 SELECT 'customer' AS source, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier)
GROUP BY source""")
def tables_by_file(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_keyed_files(spark, [f"{folder}/customer.parquet", f"{folder}/supplier.parquet"],
                            "c_acctbal double, s_acctbal double", "source", "parquet")
    means = rows.withColumn("balance", F.coalesce("c_acctbal", "s_acctbal")).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("balance").alias("balance"))
    return rounded(means, ["balance"])


@register("station_files", """SELECT 'late' AS station, o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status
 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'early', o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus <> 'O'""")
def station_files(spark: SparkSession, folder: str) -> DataFrame:
    """Two delimited tables with other columns in another order, read as one by column name."""
    orders, path = table(spark, folder, "orders"), scratch_path(spark, "stations")
    late, early = orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderstatus <> 'O'")
    write_table(late.selectExpr("o_orderkey AS key", "o_orderstatus AS status", "o_totalprice AS price"), f"{path}/late.csv", "csv")
    write_table(early.selectExpr("o_totalprice AS price", "o_orderpriority AS `priority, as said`", "o_orderkey AS key"),
                f"{path}/early.csv", "csv")
    return read_keyed_files(spark, [f"{path}/late.csv", f"{path}/early.csv"], "key bigint, price double, status string", "station")


def _untidy_lines(orders: DataFrame) -> DataFrame:
    """The orders as text lines with a preamble, a header, a sentinel, and footer notes."""
    stamp = F.date_format("o_orderdate", "yyyyMM")
    price = F.when(F.col("o_orderstatus") == "P", F.lit("-99")).otherwise(F.col("o_totalprice").cast("string"))
    lines = orders.select(F.concat_ws(",", stamp, price, F.col("o_orderkey").cast("string"),
                                      F.col("o_orderkey").cast("string")).alias("value"))
    notes = ["#  Order prices", "# Missing: -99", "Date,Total,Total,1990 = 1", ",,,",
             '"* see the caption, to the figure",,,', "** annual change,,,"]
    return lines.unionByName(orders.sparkSession.createDataFrame([(n,) for n in notes], "value string"))


@register("untidy_text_ingest", """SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year,
 CAST(month(o_orderdate) AS INTEGER) AS month, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
 'Total.1' AS second_total FROM orders""")
def untidy_text_ingest(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "untidy")
    _untidy_lines(table(spark, folder, "orders")).write.text(path)
    names = header_names(spark, path, "Date")
    schema = f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` bigint, `{names[3]}` bigint"
    rows = read_table(spark, path, schema, key="Date", key_pattern=YEAR_MONTH, comment="#",
                      sentinels={"Total": [-99.0]})
    year, month = split_year_month("Date")
    return rows.select(F.col("`Total.1`").alias("key"), year.alias("year"), month.alias("month"),
                       F.col("Total").alias("price"), F.lit(names[2]).alias("second_total"))


@register("csv_round_trip", """WITH y AS (SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS value
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT nation, year, round(value, 6) AS value FROM y""")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    yearly = entity_year_mean(nation_orders(spark, folder), "nation", "o_orderdate", "o_totalprice")
    numbered = yearly.select(F.xxhash64("nation", "year").alias("row"), "nation", "year", "value")
    path = write_table(numbered, scratch_path(spark, "yearly"), "csv")
    back = spark.read.schema(numbered.schema).csv(path, header=True)
    return rounded(drop_row_number(back), ["value"])


@register("parquet_by_year", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n,
 round(avg(o_totalprice), 6) AS value FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1""")
def parquet_by_year(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("year", year_of())
    path = write_table(orders, scratch_path(spark, "by-year"), partition_by=["year"])
    frame = spark.read.parquet(path).filter(F.col("year") == 1998)
    return rounded(frame.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("value")),
                   ["value"])


def _stored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders' moments by nation from a store that got them in three batches, one of them twice."""
    orders, path = nation_orders(spark, folder), scratch_path(spark, "moments")
    for batch, rows in (("early", "o_orderdate < '1997-03-10'"), ("middle", "o_orderdate >= '1997-03-10' and o_orderdate < '1999-11-20'"),
                        ("late", "o_orderdate >= '1999-11-20'"), ("middle", "o_orderdate >= '1997-03-10' and o_orderdate < '1999-11-20'")):
        add_batch(orders.filter(rows), path, batch, ["nation"], "o_orderdate", "o_totalprice")
    return read_store(spark, path, ["nation"])


@register("trend_from_store", TREND_SQL["trend_test"])
def trend_from_store(spark: SparkSession, folder: str) -> DataFrame:
    """The trend test from moments kept batch by batch equals that of a scan of all rows."""
    tests = trend_from_moments(_stored_orders(spark, folder), ["nation"], [PARTIAL_YEAR])
    shown = tests.select("nation", "month", "n", "slope", "slope_se", "slope_t", "slope_p")
    return rounded(rounded(rounded(shown, ["slope", "slope_se"], 4), ["slope_t"], 5), ["slope_p"], 6)


def served_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The stored moments, bucketed by nation for repeated requests."""
    path = scratch_path(spark, "served")
    return write_bucketed(_stored_orders(spark, folder), "served_" + path.rpartition("-")[2], path, "nation", 8, ["year", "month"])


@register("period_change_served", CHANGE_SQL["period_change"])
def period_change_served(spark: SparkSession, folder: str) -> DataFrame:
    served = period_change_from_moments(served_orders(spark, folder), ["nation"], 1996, 1999, bins=(PRICE_BREAKS, PRICE_LABELS))
    return rounded(served, ["baseline", "value", "diff"])


@register("yearly_served", """SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 6) AS value
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def yearly_served(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(yearly_from_moments(served_orders(spark, folder), ["nation"]), ["value"])
