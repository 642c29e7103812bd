"""Column rules, joins, aggregation rules and changes of shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.functions import values
from isotrend.functions.calendar import (ALL_MONTHS, level_index, month_name, month_number, season_of,
                                         split_year_month, year_between)
from isotrend.operators import joins, reshape
from isotrend.operators.lattice import lattice_summary
from isotrend.plans.change_queries import case_bins
from isotrend.plans.tables import (MONTH_NAMES, NATION_ORDERS, month_of, nation_orders, registrar,
                                   rounded, table, year_of)
from isotrend.session import settle

QUERIES, ORACLES, register = registrar()
BALANCE_BREAKS = (-1000, 0, 2000, 4000, 6000, 8000, 9000)
BALANCE_LABELS = ("Below 0", "0-2000", "2000-4000", "4000-6000", "6000-8000", "8000-9000")
# The years at both ends have no orders, so their columns are missing throughout.
YEARS = list(range(1993, 2004))


@register("column_choice", """SELECT o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price,
 o_orderpriority AS priority FROM orders""")
def column_choice(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    chosen = reshape.drop_positions(orders, 0, 6).select(
        *reshape.column_range(orders, "o_custkey", "o_totalprice"), "o_orderpriority")
    return chosen.withColumnsRenamed({"o_custkey": "customer", "o_orderstatus": "status",
                                      "o_totalprice": "price", "o_orderpriority": "priority"})


@register("row_filters", f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
 AND o_totalprice >= 100000 AND o_totalprice IS NOT NULL""")
def row_filters(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    kept = orders.filter(year_between("o_orderdate", 1996, 1998) & (F.col("o_orderstatus") != "P")
                         & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
                         & (F.col("o_totalprice") >= 100000) & F.col("o_totalprice").isNotNull())
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@register("sign_label", """SELECT c_custkey, CASE WHEN c_acctbal - 5000 < 0 THEN 'red' WHEN c_acctbal - 5000 >= 0 THEN 'blue' END AS balance_color,
 CASE WHEN v < 0 THEN 'red' WHEN v >= 0 THEN 'blue' END AS change_color
FROM (SELECT *, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal - 5000 END AS v FROM customer)""")
def sign_label(spark: SparkSession, folder: str) -> DataFrame:
    partly = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") - 5000)
    return table(spark, folder, "customer").select(
        "c_custkey", values.sign_label(F.col("c_acctbal") - 5000).alias("balance_color"),
        values.sign_label(partly).alias("change_color"))


@register("signif_digits", """WITH v AS (SELECT c_custkey, sqrt(abs(c_acctbal) + 1) AS v FROM customer)
SELECT c_custkey, CASE WHEN v = 0 THEN 0 ELSE
 round(round_even(v / pow(10, floor(log10(abs(v))) - 2), 0) * pow(10, floor(log10(abs(v))) - 2), 9) END AS three_digits FROM v""")
def signif_digits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey", F.round(values.signif(F.sqrt(F.abs("c_acctbal") + 1), 3), 9).alias("three_digits"))


@register("round_measures", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 3, 2) AS third,
 round(l_quantity / 7, 2) AS seventh, round(l_extendedprice * 1.8, 2) AS scaled FROM lineitem""")
def round_measures(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 3).alias("third"),
        (F.col("l_quantity") / 7).alias("seventh"), (F.col("l_extendedprice") * 1.8).alias("scaled"))
    return values.round_all(lines, ["third", "seventh", "scaled"], 2)


@register("bin_ranges", f"""SELECT c_custkey, {case_bins('c_acctbal', BALANCE_BREAKS, BALANCE_LABELS, True)} AS right_closed,
 {case_bins('floor(c_acctbal / 1000) * 1000', BALANCE_BREAKS, BALANCE_LABELS, False)} AS left_closed FROM customer""")
def bin_ranges(spark: SparkSession, folder: str) -> DataFrame:
    on_edges = F.floor(F.col("c_acctbal") / 1000) * 1000
    return table(spark, folder, "customer").select(
        "c_custkey", values.bin_label("c_acctbal", BALANCE_BREAKS, BALANCE_LABELS).alias("right_closed"),
        values.bin_label(on_edges, BALANCE_BREAKS, BALANCE_LABELS, right=False).alias("left_closed"))


@register("bin_domain", f"""WITH d AS (SELECT unnest({list(BALANCE_LABELS)}) AS label, unnest(range(1, 7)) AS ordinal),
c AS (SELECT {case_bins('c_acctbal', BALANCE_BREAKS, BALANCE_LABELS, True)} AS found, count(*) AS n FROM customer GROUP BY 1)
SELECT CAST(ordinal AS INTEGER) AS ordinal, label, CAST(coalesce(n, 0) AS BIGINT) AS n FROM d LEFT JOIN c ON label = found
UNION ALL SELECT 7, NULL, CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE found IS NULL""")
def bin_domain(spark: SparkSession, folder: str) -> DataFrame:
    label = values.bin_label("c_acctbal", BALANCE_BREAKS, BALANCE_LABELS)
    return reshape.count_domain(table(spark, folder, "customer"), label, BALANCE_LABELS)


@register("rescale_squish", """WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 8) AS share, least(greatest(c_acctbal, 0), 5000) AS squished,
 round((least(greatest(c_acctbal, -1000), 9000) + 1000) / 10000, 8) AS position FROM customer, r""")
def rescale_squish(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    ends = customers.agg(F.struct(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))).scalar()
    low, high = BALANCE_BREAKS[0], BALANCE_BREAKS[-1]
    shown = customers.select(
        "c_custkey", values.rescale("c_acctbal", ends["low"], ends["high"]).alias("share"),
        values.squish("c_acctbal", 0, 5000).alias("squished"),
        values.rescale(values.squish("c_acctbal", low, high), low, high).alias("position"))
    return rounded(shown, ["share", "position"], 8)


_DEGREES = "(c_acctbal / 3000 - 1)"
_LEVEL = "(c_acctbal / 100)"
_CUTS = values.rescale_points([b for b in values.LEVEL_BREAKS[1:-1]])


@register("map_classes", f"""SELECT c_custkey, {case_bins(_DEGREES, values.FINE_CHANGE_BREAKS, values.FINE_CHANGE_LABELS, True)} AS fine_change,
 {case_bins(_LEVEL, values.LEVEL_BREAKS, values.LEVEL_LABELS, True)} AS level,
 {case_bins(f'least(greatest({_LEVEL}, 30), 75)', values.LEVEL_BREAKS, values.LEVEL_LABELS, True)} AS squished_level,
 round({_CUTS[1]} * c_acctbal + {_CUTS[-2]}, 6) AS between_cuts FROM customer""")
def map_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of a map: fine changes, levels, levels clamped to the limits, and rescaled cut points."""
    degrees, level = F.col("c_acctbal") / 3000 - 1, F.col("c_acctbal") / 100
    cuts = values.rescale_points(list(values.LEVEL_BREAKS[1:-1]))
    shown = table(spark, folder, "customer").select(
        "c_custkey", values.bin_label(degrees, values.FINE_CHANGE_BREAKS, values.FINE_CHANGE_LABELS).alias("fine_change"),
        values.bin_label(level, values.LEVEL_BREAKS, values.LEVEL_LABELS).alias("level"),
        values.bin_label(values.squish(level, 30, 75), values.LEVEL_BREAKS, values.LEVEL_LABELS).alias("squished_level"),
        (cuts[1] * F.col("c_acctbal") + cuts[-2]).alias("between_cuts"))
    return rounded(shown, ["between_cuts"])


@register("label_text", f"""WITH {NATION_ORDERS}, m AS (SELECT nation,
 avg(CASE WHEN yr = 1996 THEN o_totalprice END) AS a, avg(CASE WHEN yr = 1999 AND nation <> 'NATION_4' THEN o_totalprice END) AS b
 FROM nation_orders GROUP BY nation)
SELECT nation, 'Nation: ' || nation || '<br>Avg (1996): ' || coalesce(CAST(CAST(round(a, 0) AS BIGINT) AS VARCHAR), 'NA')
 || '<br>Avg (1999): ' || coalesce(CAST(CAST(round(b, 0) AS BIGINT) AS VARCHAR), 'NA') || '<br>'
 || coalesce(CASE WHEN b - a >= 0 THEN 'hotter' WHEN b - a < 0 THEN 'colder' END, 'NA') || ' than 1996' AS hover FROM m""")
def label_text(spark: SparkSession, folder: str) -> DataFrame:
    later = (year_of() == 1999) & (F.col("nation") != "NATION_4")
    means = nation_orders(spark, folder).groupBy("nation").agg(
        reshape.mean_where("o_totalprice", year_of() == 1996).alias("a"),
        reshape.mean_where("o_totalprice", later).alias("b"))
    diff = F.col("b") - F.col("a")
    return means.select("nation", values.label_text(
        "Nation: ", F.col("nation"), "<br>Avg (1996): ", values.number_text(F.round("a", 0)),
        "<br>Avg (1999): ", values.number_text(F.round("b", 0)), "<br>",
        values.sign_label(diff, "colder", "hotter"), " than 1996").alias("hover"))


@register("calendar_parts", f"""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
 {MONTH_NAMES}[month(o_orderdate)] AS name, CAST(month(o_orderdate) AS INTEGER) AS number,
 CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring'
  WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS season,
 CAST(year(o_orderdate) AS INTEGER) AS stamp_year, CAST(month(o_orderdate) AS INTEGER) AS stamp_month FROM orders""")
def calendar_parts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", year_of().alias("year"), month_of().alias("month"))
    named = orders.withColumn("name", month_name("month"))
    stamp_year, stamp_month = split_year_month(F.col("year") * 100 + F.col("month"))
    return named.withColumns({"number": month_number("name"), "season": season_of("name"),
                              "stamp_year": stamp_year, "stamp_month": stamp_month})


@register("recode_levels", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status,
 CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS level, replace(replace(o_orderpriority, '-', ''), 'SPECIFIED', '') AS stripped FROM orders""")
def recode_levels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", values.recode("o_orderstatus", {"F": "Filled", "O": "Open"}).alias("status"),
        level_index("o_orderstatus", ["O", "F"]).alias("level"),
        values.strip_text("o_orderpriority", "-", "SPECIFIED").alias("stripped"))


@register("safe_math", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_discount, 0), 6) AS ratio,
 round(abs(l_discount - l_tax), 6) AS gap, l_discount IS NULL OR l_discount = 0 AS no_discount FROM lineitem""")
def safe_math(spark: SparkSession, folder: str) -> DataFrame:
    ratio = F.try_divide("l_extendedprice", "l_discount")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.nan_to_null(ratio).alias("ratio"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        (F.col("l_discount").isNull() | (F.col("l_discount") == 0)).alias("no_discount"))
    return rounded(lines, ["ratio", "gap"])


@register("left_join_keys", """SELECT c_custkey, n_name, r_name FROM customer
 LEFT JOIN nation ON n_nationkey = CASE WHEN c_nationkey < 20 THEN c_nationkey END LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_join_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = F.when(F.col("c_nationkey") < 20, F.col("c_nationkey"))
    customers = table(spark, folder, "customer").select("c_custkey", key.alias("nation_key"))
    named = joins.left_join(customers, table(spark, folder, "nation"), {"nation_key": "n_nationkey"})
    regions = joins.left_join(named, table(spark, folder, "region"), {"n_regionkey": "r_regionkey"})
    return regions.select("c_custkey", "n_name", "r_name")


@register("driver_join", """WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS price FROM orders GROUP BY 1),
l AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1),
r AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS returned FROM lineitem
 WHERE l_returnflag = 'R' AND year(l_shipdate) >= 1997 GROUP BY 1)
SELECT o.year, round(price, 6) AS price, quantity, round(discount, 8) AS discount, CAST(returned AS BIGINT) AS returned
FROM o LEFT JOIN l ON o.year = l.year LEFT JOIN r ON o.year = r.year""")
def driver_join(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    shipped = F.year("l_shipdate").alias("year")
    prices = table(spark, folder, "orders").groupBy(year_of().alias("year")).agg(F.avg("o_totalprice").alias("price"))
    # Both yearly tables of the line items come from one scan; a year without returns has no row in the second.
    late = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1997-01-01"))
    yearly = settle(lines.groupBy(shipped).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
                                               F.count_if(late).alias("returned")))
    drivers = [yearly.drop("returned"), yearly.filter("returned > 0").select("year", "returned")]
    joined = joins.join_drivers(prices, drivers, "year")
    return rounded(rounded(joined, ["price"]), ["discount"], 8)


@register("area_attributes", f"""WITH {NATION_ORDERS}, a AS (SELECT nation, count(*) AS n, max(o_totalprice) AS top FROM nation_orders
 GROUP BY nation)
SELECT n_nationkey, n_name, n_regionkey, CAST(n AS BIGINT) AS n, top FROM nation LEFT JOIN a ON n_name = nation WHERE n_regionkey <> 2""")
def area_attributes(spark: SparkSession, folder: str) -> DataFrame:
    orders = nation_orders(spark, folder).groupBy("nation").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return joins.area_attributes(table(spark, folder, "nation"), orders, {"n_name": "nation"},
                                 exclude=F.col("n_regionkey") == 2)


@register("strict_mean_left_join", """WITH j AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, o_totalprice
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
SELECT segment, nation, round(CASE WHEN count(o_totalprice) = count(*) THEN avg(o_totalprice) END, 6) AS strict,
 round(avg(o_totalprice), 6) AS lenient FROM j GROUP BY ALL""")
def strict_mean_left_join(spark: SparkSession, folder: str) -> DataFrame:
    # One row per customer before the join, so that a customer with many orders is no hot key.
    parts = reshape.mean_parts(table(spark, folder, "orders"), ["o_custkey"], "o_totalprice")
    joined = joins.left_join(table(spark, folder, "customer"), parts, {"c_custkey": "o_custkey"})
    strict, lenient = reshape.means_of_parts()
    means = joined.groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(
        strict.alias("strict"), lenient.alias("lenient"))
    return rounded(means, ["strict", "lenient"], 6)


@register("period_baseline", """SELECT round(avg(o_totalprice) FILTER (year(o_orderdate) BETWEEN 1995 AND 1997), 6) AS baseline,
 round(avg(o_totalprice) FILTER (year(o_orderdate) = 2000), 6) AS recent,
 round(sum(o_totalprice) FILTER (month(o_orderdate) = 1), 2) AS january FROM orders""")
def period_baseline(spark: SparkSession, folder: str) -> DataFrame:
    january = F.sum(F.when(month_of() == 1, F.col("o_totalprice")))
    means = table(spark, folder, "orders").agg(
        reshape.mean_where("o_totalprice", year_of().between(1995, 1997)).alias("baseline"),
        reshape.mean_where("o_totalprice", year_of() == 2000).alias("recent"), F.round(january, 2).alias("january"))
    return rounded(means, ["baseline", "recent"])


@register("choice_lists", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment")
def choice_lists(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.choice_list(table(spark, folder, "customer"), "c_mktsegment")


@register("year_range", """SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS first_year,
 CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders""")
def year_range(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").agg(F.min(year_of()).alias("first_year"), F.max(year_of()).alias("last_year"))


@register("monthly_totals", f"""WITH {NATION_ORDERS}
SELECT nation, coalesce({MONTH_NAMES}[mon], 'All Months') AS month, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM nation_orders GROUP BY GROUPING SETS ((nation), (nation, mon))""")
def monthly_totals(spark: SparkSession, folder: str) -> DataFrame:
    orders = nation_orders(spark, folder).withColumn("month", month_name(month_of()))
    totals = reshape.with_total_sums(orders, ["nation"], "month", {"n": F.count(F.lit(1)), "total": F.sum("o_totalprice")},
                                     ALL_MONTHS)
    return rounded(totals, ["total"], 2)


def _pivoted(spark: SparkSession, folder: str) -> DataFrame:
    means = nation_orders(spark, folder).groupBy("nation", year_of().alias("year")).agg(F.avg("o_totalprice").alias("value"))
    return reshape.to_wide(means, "nation", "year", "value", YEARS, "v")


_WIDE = f"""WITH {NATION_ORDERS}, m AS (SELECT nation, yr AS year, avg(o_totalprice) AS value
 FROM nation_orders GROUP BY ALL)"""


@register("pivot_years", f"""{_WIDE} SELECT nation, {', '.join(f"round(max(CASE WHEN year = {y} THEN value END), 6) AS v{y}" for y in YEARS)}
FROM m GROUP BY nation""")
def pivot_years(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_pivoted(spark, folder), [f"v{y}" for y in YEARS])


@register("unpivot_keep_nulls", f"""{_WIDE}, years AS (SELECT unnest({[f"v{y}" for y in YEARS]}) AS name, unnest({YEARS}) AS year),
areas AS (SELECT DISTINCT nation FROM m)
SELECT a.nation, y.name, round(m.value, 6) AS value FROM areas a CROSS JOIN years y
LEFT JOIN m ON m.nation = a.nation AND m.year = y.year""")
def unpivot_keep_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reshape.to_long(_pivoted(spark, folder), ["nation"]), ["value"])


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("describe_measures", " UNION ALL ".join(
    f"""SELECT '{c}' AS measure, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd,
 CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM lineitem""" for c in _MEASURES))
def describe_measures(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reshape.describe_measures(table(spark, folder, "lineitem"), _MEASURES), ["mean", "sd"], 6)


@register("lattice_summary", f"""WITH o AS (SELECT n_name AS nation, r_name AS region, CAST(month(o_orderdate) AS VARCHAR) AS month,
 'Q' || quarter(o_orderdate) AS season, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, -3) END AS v
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT area.nation, area.region, span.month, span.season, v FROM o,
 (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([1, 2, 3]) AS t),
 LATERAL (SELECT CASE WHEN a = 1 THEN o.nation ELSE 'All' END AS nation, CASE WHEN a < 3 THEN o.region ELSE 'All' END AS region) area,
 LATERAL (SELECT CASE WHEN t = 1 THEN o.month ELSE 'All' END AS month, CASE WHEN t < 3 THEN o.season ELSE 'All' END AS season) span),
g AS (SELECT nation, region, month, season, count(*) AS rows, count(v) AS n, avg(v) AS mean, min(v) AS low, max(v) AS high,
 quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM e GROUP BY ALL),
x AS (SELECT e.nation, e.region, e.month, e.season, count(*) FILTER (v = low) AS low_rows, count(*) FILTER (v = high) AS high_rows
 FROM e JOIN g USING (nation, region, month, season) GROUP BY ALL)
SELECT nation, region, month, season, CAST(rows AS BIGINT) AS rows, CAST(n AS BIGINT) AS n, round(mean, 5) AS mean,
 round(CASE WHEN rows = n THEN mean END, 5) AS strict_mean, low, high, CAST(low_rows AS BIGINT) AS low_rows, CAST(high_rows AS BIGINT) AS high_rows,
 round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75 FROM g JOIN x USING (nation, region, month, season)""")
def lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Prices by nation, region and all, for each month, quarter and all: measures that do not add up."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("nation"), "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("region"))
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    rows = joins.left_join(orders, customer, {"o_custkey": "c_custkey"}, null_safe=False)
    rows = joins.left_join(rows, nation, {"c_nationkey": "n_nationkey"}, null_safe=False)
    rows = joins.left_join(rows, region, {"n_regionkey": "r_regionkey"}, null_safe=False)
    # A price that is still open is NaN, which counts as missing.
    price = F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.round("o_totalprice", -3))
    rows = rows.select("nation", "region", F.month("o_orderdate").cast("string").alias("month"),
                       F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("season"), price.alias("price"))
    found = lattice_summary(rows, ["nation", "region"], ["month", "season"], "price")
    return rounded(rounded(found, ["mean", "strict_mean"], 5), ["q25", "q50", "q75"], 4)
