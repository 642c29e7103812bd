"""Baselines, anomalies and changes by nation, segment, month and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.functions.calendar import month_name
from isotrend.operators import change, reshape
from isotrend.operators.joins import attach
from isotrend.plans.tables import (MONTH_NAMES, NATION_ORDERS, PARTIAL_YEAR, month_of, nation_orders, registrar,
                                   rounded, table, year_of)

QUERIES, ORACLES, register = registrar()
# Edges in the unit of the order prices, wide enough for single months.
PRICE_BREAKS = (float("-inf"), *range(-12000, 12001, 4000), float("inf"))
PRICE_LABELS = ("below", *[f"{a} to {a + 4000}" for a in range(-12000, 12000, 4000)], "above")
CHANGE_BREAKS = tuple(range(-21000, 21001, 3500))
CHANGE_LABELS = tuple(f"{a} to {b}" for a, b in zip(CHANGE_BREAKS, CHANGE_BREAKS[1:]))


def case_bins(value: str, breaks, labels, right: bool) -> str:
    """SQL text of a labelled bin."""
    def bound(op: str, edge: float) -> str:
        return "TRUE" if edge in (float("inf"), float("-inf")) else f"{value} {op} {edge}"

    low, high = (">", "<=") if right else (">=", "<")
    arms = " ".join(f"WHEN {bound(low, a)} AND {bound(high, b)} THEN '{label}'"
                    for a, b, label in zip(breaks, breaks[1:], labels))
    return f"CASE WHEN {value} IS NULL THEN NULL {arms} END"


YEARLY = f"""WITH {NATION_ORDERS},
 yearly AS (SELECT nation, yr AS year, avg(o_totalprice) AS value FROM nation_orders GROUP BY ALL)"""


@register("entity_year_mean", f"""{YEARLY}
SELECT nation, year, round(value, 6) AS value FROM yearly WHERE year >= 1996""")
def entity_year_mean(spark: SparkSession, folder: str) -> DataFrame:
    orders = nation_orders(spark, folder)
    return rounded(change.entity_year_mean(orders, "nation", "o_orderdate", "o_totalprice", since=1996), ["value"])


@register("entity_series", f"""WITH {NATION_ORDERS}
SELECT yr AS year, round(avg(o_totalprice), 6) AS value FROM nation_orders
WHERE nation = 'NATION_7' AND mon = 3 AND yr <> {PARTIAL_YEAR} GROUP BY yr ORDER BY yr""")
def entity_series(spark: SparkSession, folder: str) -> DataFrame:
    orders = nation_orders(spark, folder)
    return rounded(change.entity_series(orders, "nation", "NATION_7", "o_orderdate", "o_totalprice", month=3,
                                        drop_year=PARTIAL_YEAR), ["value"])


@register("season_slice", f"""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
 {MONTH_NAMES}[month(o_orderdate)] AS month, o_totalprice FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND month(o_orderdate) IN (12, 1, 2)""")
def season_slice(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("month", month_name(month_of()))
    winters = change.season_slice(orders, "o_orderdate", "month", 1996, 1999, "Winter")
    return winters.select("o_orderkey", year_of().alias("year"), "month", "o_totalprice")


def _period_sql(month: str) -> str:
    return f"""WITH {NATION_ORDERS}, means AS (
 SELECT nation, avg(CASE WHEN yr = 1996 THEN o_totalprice END) AS baseline,
        avg(CASE WHEN yr = 1999 THEN o_totalprice END) AS value
 FROM nation_orders WHERE yr IN (1996, 1999) {month} GROUP BY nation)
SELECT nation, round(baseline, 6) AS baseline, round(value, 6) AS value, round(value - baseline, 6) AS diff,
 {case_bins('(value - baseline)', PRICE_BREAKS, PRICE_LABELS, False)} AS category
FROM means WHERE value - baseline IS NOT NULL"""


def _period(spark: SparkSession, folder: str, month: int | None) -> DataFrame:
    changed = change.period_change(nation_orders(spark, folder), "nation", "o_orderdate", "o_totalprice",
                                   1996, 1999, month, (PRICE_BREAKS, PRICE_LABELS))
    return rounded(changed, ["baseline", "value", "diff"])


@register("period_change", _period_sql(""))
def period_change(spark: SparkSession, folder: str) -> DataFrame:
    return _period(spark, folder, None)


@register("period_change_month", _period_sql("AND mon = 10"))
def period_change_month(spark: SparkSession, folder: str) -> DataFrame:
    return _period(spark, folder, 10)


_FRAME_COLUMNS = f"""nation, year, round(value, 6) AS value, round(reference, 6) AS reference,
 round(value - reference, 6) AS diff, {case_bins('(value - reference)', CHANGE_BREAKS, CHANGE_LABELS, True)} AS category,
 CASE WHEN value - reference >= 0 THEN 'hotter' WHEN value - reference < 0 THEN 'colder' END AS direction"""
_FRAMES = f"""{YEARLY}, framed AS (
 SELECT y.nation, y.year, y.value, r.value AS reference FROM yearly y
 LEFT JOIN (SELECT nation, value FROM yearly WHERE year = 1997) r ON y.nation = r.nation)
SELECT {_FRAME_COLUMNS} FROM framed"""


@register("change_frames", _FRAMES)
def change_frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = change.change_frames(nation_orders(spark, folder), "nation", "o_orderdate", "o_totalprice", 1997,
                                  (CHANGE_BREAKS, CHANGE_LABELS))
    return rounded(frames, ["value", "reference", "diff"])


@register("change_vs_reference_year", _FRAMES + " WHERE year = 2000")
def change_vs_reference_year(spark: SparkSession, folder: str) -> DataFrame:
    frame = change.change_vs_reference_year(nation_orders(spark, folder), "nation", "o_orderdate", "o_totalprice",
                                            2000, 1997, (CHANGE_BREAKS, CHANGE_LABELS))
    return rounded(frame, ["value", "reference", "diff"])


@register("year_over_year", f"""{YEARLY}
SELECT y.nation, y.year, round(y.value, 6) AS value, round(p.value, 6) AS previous,
 round(y.value - p.value, 6) AS diff, {case_bins('(y.value - p.value)', CHANGE_BREAKS, CHANGE_LABELS, True)} AS category
FROM yearly y LEFT JOIN yearly p ON p.nation = y.nation AND p.year = y.year - 1""")
def year_over_year(spark: SparkSession, folder: str) -> DataFrame:
    changed = change.year_over_year(nation_orders(spark, folder), "nation", "o_orderdate", "o_totalprice",
                                    bins=(CHANGE_BREAKS, CHANGE_LABELS))
    return rounded(changed, ["value", "previous", "diff"])


@register("baseline_anomaly", f"""WITH {NATION_ORDERS}, base AS (
 SELECT nation, avg(o_totalprice) AS baseline FROM nation_orders WHERE yr BETWEEN 1995 AND 1997 GROUP BY nation)
SELECT o.nation, yr AS year, o_totalprice, round(baseline, 6) AS baseline,
 round(o_totalprice - baseline, 6) AS anomaly
FROM nation_orders o LEFT JOIN base b ON o.nation = b.nation WHERE mon = 1""")
def baseline_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    orders = nation_orders(spark, folder).withColumn("year", year_of())
    rows = change.baseline_anomaly(orders, ["nation"], "o_orderdate", "o_totalprice", (1995, 1997), month_of() == 1)
    return rounded(rows.drop("o_orderdate"), ["baseline", "anomaly"], 6)


@register("global_baseline_anomaly", """SELECT o_orderkey, o_totalprice,
 round((SELECT avg(o_totalprice) FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997), 6) AS baseline,
 round(o_totalprice - (SELECT avg(o_totalprice) FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997), 6) AS anomaly
FROM orders""")
def global_baseline_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    rows = change.baseline_anomaly(orders, [], "o_orderdate", "o_totalprice", (1995, 1997))
    return rounded(rows.drop("o_orderdate"), ["baseline", "anomaly"])



@register("climatology_anomaly", """WITH normal AS (
 SELECT CAST(month(o_orderdate) AS INTEGER) AS month, avg(o_totalprice) AS baseline
 FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY ALL)
SELECT o_orderkey, o_totalprice, CAST(month(o_orderdate) AS INTEGER) AS month, round(baseline, 6) AS baseline,
 round(o_totalprice - baseline, 6) AS anomaly
FROM orders LEFT JOIN normal ON month(o_orderdate) = normal.month""")
def climatology_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate",
                                                   month_of().alias("month"))
    rows = change.climatology_anomaly(orders, "month", "o_orderdate", "o_totalprice", (1995, 1997))
    return rounded(rows.drop("o_orderdate"), ["baseline", "anomaly"])


@register("climatology_anomaly_by_entity", """WITH seg AS (
 SELECT o_orderkey, c_mktsegment AS segment, o_totalprice, o_orderdate, CAST(month(o_orderdate) AS INTEGER) AS month
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey), normal AS (
 SELECT segment, month, avg(o_totalprice) AS baseline FROM seg WHERE year(o_orderdate) BETWEEN 1995 AND 1997
 GROUP BY ALL)
SELECT o_orderkey, s.segment, s.month, round(o_totalprice - baseline, 6) AS anomaly
FROM seg s LEFT JOIN normal n ON s.segment = n.segment AND s.month = n.month""")
def climatology_anomaly_by_entity(spark: SparkSession, folder: str) -> DataFrame:
    segments = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                       F.col("c_mktsegment").alias("segment"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                                   month_of().alias("month"))
    rows = change.climatology_anomaly(attach(orders, segments, "o_custkey"), "month", "o_orderdate",
                                      "o_totalprice", (1995, 1997), ["segment"])
    return rounded(rows.select("o_orderkey", "segment", "month", "anomaly"), ["anomaly"])


@register("percent_change", f"""WITH m AS (
 SELECT {MONTH_NAMES}[month(o_orderdate)] AS month, avg(CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice END) AS a,
  avg(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice END) AS b
 FROM orders WHERE year(o_orderdate) IN (1995, 2000) GROUP BY 1)
SELECT month, round(a, 6) AS first_value, round(b, 6) AS last_value, round((b - a) / abs(a) * 100, 6) AS percent_change
FROM m""")
def percent_change(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("month", month_name(month_of()))
    changed = change.percent_change(orders, "month", "o_orderdate", "o_totalprice", 1995, 2000)
    return rounded(rounded(changed, ["first_value", "last_value"]), ["percent_change"], 6)


@register("group_extremes", f"""WITH monthly AS (
 SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {MONTH_NAMES}[month(o_orderdate)] AS month,
  round(avg(o_totalprice) / 1000, 0) AS value FROM orders GROUP BY ALL)
SELECT year, month, value FROM monthly m WHERE value = (SELECT max(value) FROM monthly x WHERE x.month = m.month)""")
def group_extremes(spark: SparkSession, folder: str) -> DataFrame:
    monthly = table(spark, folder, "orders").groupBy(
        year_of().alias("year"), month_name(month_of()).alias("month")) \
        .agg(F.round(F.avg("o_totalprice") / 1000, 0).alias("value"))
    return reshape.group_extremes(monthly, ["month"], "value").select("year", "month", "value")


@register("group_extremes_rows", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
 l_quantity, l_extendedprice FROM lineitem l
 WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem x
  WHERE x.l_returnflag = l.l_returnflag AND x.l_linestatus = l.l_linestatus)""")
def group_extremes_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                    "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return reshape.group_extremes(lines, ["l_returnflag", "l_linestatus"], "l_quantity")


@register("year_snapshot", f"""{YEARLY}
SELECT n_nationkey, n_name, n_regionkey, round(value, 6) AS value, {case_bins('value', (0, 240000, 250000, 260000, 500000),
 ('low', 'middle', 'high', 'top'), True)} AS category
FROM nation LEFT JOIN (SELECT * FROM yearly WHERE year = 1998) y ON n_name = y.nation WHERE n_name <> 'NATION_13'""")
def year_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    orders = nation_orders(spark, folder).withColumnRenamed("o_totalprice", "value")
    areas = table(spark, folder, "nation").filter(F.col("n_name") != "NATION_13")
    shown = change.year_snapshot(orders, areas, "n_name", "nation", "o_orderdate", "value", 1998,
                                 ((0, 240000, 250000, 260000, 500000), ("low", "middle", "high", "top")))
    return rounded(shown, ["value"])


@register("tag_and_stack", """SELECT c_custkey AS id, round(c_acctbal * 1.8, 6) AS balance, c_mktsegment AS segment,
 'customer' AS source FROM customer
UNION ALL SELECT s_suppkey, round(s_acctbal, 6), NULL, 'supplier' FROM supplier""")
def tag_and_stack(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"),
                                                        F.col("c_acctbal").alias("balance"),
                                                        F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"),
                                                        F.col("s_acctbal").alias("balance"))
    stacked = change.tag_and_stack({"customer": customers, "supplier": suppliers}, {"customer": ("balance", 1.8)})
    return rounded(stacked, ["balance"])
