"""Trends by group with their significance, bands and local curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.functions.calendar import month_name, not_in_years
from isotrend.operators import reshape, trend
from isotrend.operators.change import entity_year_mean
from isotrend.operators.smooth import loess_band as smoothed_band
from isotrend.operators.smooth import loess_curve, loess_values
from isotrend.plans.sql_text import t_p_value, t_quantile_975
from isotrend.plans.tables import (MONTH_NAMES, NATION_ORDERS, PARTIAL_YEAR, month_of, nation_orders, registrar,
                                   rounded, table)

QUERIES, ORACLES, register = registrar()


_LINE = """ count(*) AS n, CASE WHEN regr_sxx({y}, {x}) > 0 THEN regr_slope({y}, {x}) END AS slope, regr_intercept({y}, {x}) AS intercept,
 regr_r2({y}, {x}) AS r2, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy,
 regr_avgx({y}, {x}) AS mean_x"""
_ERRORS = """sqrt((syy - slope * sxy) / (n - 2)) AS sigma,
 sqrt((syy - slope * sxy) / (n - 2)) / sqrt(sxx) AS se"""


@register("trend_simple", f"""WITH m AS (
 SELECT l_returnflag, {_LINE.format(y='l_extendedprice', x='l_quantity')} FROM lineitem GROUP BY l_returnflag),
e AS (SELECT *, {_ERRORS} FROM m)
SELECT l_returnflag, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 4) AS intercept,
 round(r2, 10) AS r2, round(sigma, 4) AS sigma, round(se, 6) AS slope_se, round(slope / se, 6) AS slope_t,
 round({t_p_value('(slope / se)', '(n - 2)')}, 6) AS slope_p,
 round(sigma * sqrt(1.0 / n + mean_x * mean_x / sxx), 6) AS intercept_se,
 round(slope * sqrt(sxx / syy), 8) AS slope_scaled, round(se * sqrt(sxx / syy), 10) AS slope_se_scaled,
 round(slope / sqrt(syy / (n - 1)), 10) AS slope_scaled_y, round(se / sqrt(syy / (n - 1)), 10) AS slope_se_scaled_y, round(1 - (1 - r2) * (n - 1) / (n - 2), 10) AS adj_r2
FROM e""")
def trend_simple(spark: SparkSession, folder: str) -> DataFrame:
    fit = trend.standardised_slope(trend.trend_fit(table(spark, folder, "lineitem"), "l_quantity",
                                                   "l_extendedprice", ["l_returnflag"]))
    shown = fit.select("l_returnflag", "n", "slope", "intercept", "r2", "sigma", "slope_se", "slope_t", "slope_p",
                       "intercept_se", "slope_scaled", "slope_se_scaled", "slope_scaled_y", "slope_se_scaled_y", "adj_r2")
    shown = rounded(shown, ["slope", "slope_se", "slope_t", "slope_p", "intercept_se"], 6)
    shown = rounded(rounded(shown, ["intercept", "sigma"], 4), ["slope_scaled"], 8)
    return rounded(shown, ["r2", "adj_r2", "slope_se_scaled", "slope_scaled_y", "slope_se_scaled_y"], 10)


@register("trend_with_nan", f"""WITH m AS (SELECT l_returnflag, {_LINE.format(y='l_extendedprice', x='l_quantity')},
 avg(l_extendedprice) AS mean, max(l_extendedprice) AS top FROM lineitem WHERE l_linenumber <> 2 GROUP BY l_returnflag)
SELECT l_returnflag, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(mean, 6) AS mean,
 top FROM m""")
def trend_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """NaN counts as missing in a fit, a mean and a maximum."""
    price = F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_extendedprice"))
    lines = table(spark, folder, "lineitem").withColumn("l_extendedprice", price)
    fit = trend.trend_fit(lines, "l_quantity", "l_extendedprice", ["l_returnflag"])
    means = lines.groupBy("l_returnflag").agg(reshape.mean_of("l_extendedprice").alias("mean"),
                                              reshape.value_at("l_extendedprice", F.lit(True)).alias("top"))
    shown = fit.join(means, "l_returnflag").select("l_returnflag", "n", "slope", "intercept", "mean", "top")
    return rounded(rounded(shown, ["slope", "mean"], 6), ["intercept"], 4)


@register("residual_summary", f"""WITH m AS (
 SELECT l_returnflag AS flag, {_LINE.format(y='l_extendedprice', x='l_quantity')} FROM lineitem GROUP BY 1),
r AS (SELECT l_returnflag, l_extendedprice - intercept - slope * l_quantity AS residual
 FROM lineitem JOIN m ON l_returnflag = flag)
SELECT l_returnflag, round(min(residual), 3) AS min, round(quantile_cont(residual, 0.25), 3) AS q1,
 round(quantile_cont(residual, 0.5), 3) AS median, round(quantile_cont(residual, 0.75), 3) AS q3,
 round(max(residual), 3) AS max FROM r GROUP BY l_returnflag""")
def residual_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    summary = trend.residual_summary(lines, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(summary, ["min", "q1", "median", "q3", "max"], 3)


_TESTS = f"""WITH {NATION_ORDERS}, base AS (SELECT * FROM nation_orders WHERE yr <> {PARTIAL_YEAR}),
m AS (SELECT nation, coalesce({MONTH_NAMES}[mon], 'All Months') AS month, {_LINE.format(y='o_totalprice', x='yr')}
 FROM base GROUP BY GROUPING SETS ((nation), (nation, mon)) HAVING count(*) > 1),
e AS (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) / sqrt(nullif(sxx, 0)) END AS se FROM m),
tests AS (SELECT *, slope / nullif(se, 0) AS t, {t_p_value('(slope / nullif(se, 0))', '(n - 2)')} AS p FROM e),
s AS (SELECT *, slope IS NOT NULL AS fitted, coalesce(p < 0.05, FALSE) AS sig FROM tests)"""
_COUNTS = """CAST(count(*) FILTER (fitted AND sig) AS BIGINT) AS significant,
 CAST(count(*) FILTER (fitted AND sig AND slope > 0) AS BIGINT) AS positive,
 CAST(count(*) FILTER (fitted AND sig AND slope < 0) AS BIGINT) AS negative,
 CAST(count(*) FILTER (fitted AND NOT sig) AS BIGINT) AS not_significant"""


def nation_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The trend test of every nation, for each month and all of them."""
    return trend.trend_test(nation_orders(spark, folder), "nation", month_name(month_of()), "o_orderdate",
                            "o_totalprice", [PARTIAL_YEAR])


@register("trend_test", f"""{_TESTS}
SELECT nation, month, CAST(n AS BIGINT) AS n, round(slope, 4) AS slope, round(se, 4) AS slope_se, round(t, 5) AS slope_t,
 round(p, 6) AS slope_p FROM tests""")
def trend_test(spark: SparkSession, folder: str) -> DataFrame:
    shown = nation_tests(spark, folder).select("nation", "month", "n", "slope", "slope_se", "slope_t", "slope_p")
    return rounded(rounded(rounded(shown, ["slope", "slope_se"], 4), ["slope_t"], 5), ["slope_p"], 6)


@register("significance_by_month", f"{_TESTS} SELECT month, {_COUNTS} FROM s GROUP BY month")
def significance_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return trend.significance_by_month(nation_tests(spark, folder))


@register("significance_by_entity", f"""{_TESTS}, c AS (SELECT nation, {_COUNTS} FROM s GROUP BY nation)
SELECT *, positive - negative AS slope_diff FROM c""")
def significance_by_entity(spark: SparkSession, folder: str) -> DataFrame:
    return trend.significance_by_entity(nation_tests(spark, folder), "nation")


@register("significance_map", f"""{_TESTS}, c AS (SELECT nation, {_COUNTS} FROM s GROUP BY nation)
SELECT n_nationkey, n_name, n_regionkey, significant, positive, negative, not_significant,
 positive - negative AS slope_diff FROM nation LEFT JOIN c ON n_name = c.nation""")
def significance_map(spark: SparkSession, folder: str) -> DataFrame:
    return trend.significance_map(table(spark, folder, "nation"), nation_tests(spark, folder), "n_name", "nation")


@register("significance_long", f"""{_TESTS}, c AS (SELECT month, {_COUNTS} FROM s GROUP BY month),
long AS (SELECT month, significant, 'Negative Slope Counties' AS category, 3 AS category_ordinal, negative AS count FROM c
 UNION ALL SELECT month, significant, 'Not Significant', 2, not_significant FROM c
 UNION ALL SELECT month, significant, 'Positive Slope Counties', 1, positive FROM c)
SELECT nullif(month, 'All Months') AS month,
 CAST(list_position({MONTH_NAMES}, month) AS INTEGER) AS month_ordinal,
 significant, category, CAST(category_ordinal AS INTEGER) AS category_ordinal, count FROM long""")
def significance_long(spark: SparkSession, folder: str) -> DataFrame:
    return trend.significance_long(trend.significance_by_month(nation_tests(spark, folder)))


@register("trend_delta", f"""WITH {NATION_ORDERS}, yearly AS (
 SELECT nation, yr, avg(o_totalprice) AS value FROM nation_orders WHERE yr <> {PARTIAL_YEAR} GROUP BY ALL),
m AS (SELECT nation, regr_slope(value, yr) AS slope, regr_intercept(value, yr) AS intercept FROM yearly GROUP BY nation),
d AS (SELECT nation, round((intercept + slope * 2000) - (intercept + slope * 1995), 3) AS delta FROM m)
SELECT nation, delta, round(delta / 5, 3) AS per_year FROM d""")
def trend_delta(spark: SparkSession, folder: str) -> DataFrame:
    orders = nation_orders(spark, folder)
    whole_years = orders.filter(not_in_years(orders, "o_orderdate", [PARTIAL_YEAR]))
    yearly = entity_year_mean(whole_years, "nation", "o_orderdate", "o_totalprice")
    fit = trend.trend_fit(yearly, "year", "value", ["nation"])
    return trend.trend_delta(fit, 1995, 2000).select("nation", "delta", "per_year")


@register("trend_band", f"""WITH m AS (
 SELECT l_returnflag, {_LINE.format(y='l_extendedprice', x='l_quantity')}, min(l_quantity) AS low, max(l_quantity) AS high
 FROM lineitem GROUP BY l_returnflag),
g AS (SELECT *, {_ERRORS} FROM m),
p AS (SELECT *, low + (high - low) * point / 79 AS x FROM g, (SELECT unnest(range(0, 80)) AS point)),
f AS (SELECT *, intercept + slope * x AS fitted, sigma * sqrt(1.0 / n + (x - mean_x) * (x - mean_x) / sxx) AS s FROM p)
SELECT l_returnflag, CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(fitted, 3) AS fitted, round(s, 4) AS se,
 round(fitted - {t_quantile_975('(n - 2)')} * s, 3) AS lower,
 round(fitted + {t_quantile_975('(n - 2)')} * s, 3) AS upper FROM f""")
def trend_band(spark: SparkSession, folder: str) -> DataFrame:
    band = trend.trend_band(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(rounded(band, ["x"], 6), ["se"], 4), ["fitted", "lower", "upper"], 3)


_CURVE = """WITH d AS (SELECT l_returnflag AS flag, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS x,
 count(*) AS c, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
e AS (SELECT flag, min(x) AS low, max(x) AS high, sum(c) AS total FROM d GROUP BY flag),
p AS (SELECT d.flag, point, d.x, y, c, floor(total * 0.75 + 0.00001) AS q, low + (high - low) * point / 79 AS x0
 FROM d JOIN e ON d.flag = e.flag, (SELECT unnest(range(0, 80)) AS point)),
o AS (SELECT *, abs(x - x0) AS dist, sum(c) OVER (PARTITION BY flag, point ORDER BY abs(x - x0)) AS after FROM p),
h AS (SELECT flag, point, min(dist) AS reach FROM o WHERE after >= q GROUP BY ALL),
w AS (SELECT o.flag, o.point, x0, y, (x - x0) / reach AS s,
 CASE WHEN dist < reach THEN pow(1 - pow(dist / reach, 3), 3) * c ELSE 0 END AS w
 FROM o JOIN h ON o.flag = h.flag AND o.point = h.point),
a AS (SELECT flag, point, first(x0) AS x, sum(w) AS s0, sum(w * s) AS s1, sum(w * s * s) AS s2, sum(w * s * s * s) AS s3,
 sum(w * s * s * s * s) AS s4, sum(w * y) AS t0, sum(w * s * y) AS t1, sum(w * s * s * y) AS t2
 FROM w WHERE w > 0 GROUP BY ALL)
SELECT flag AS l_returnflag, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
 round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)), 3) AS smooth FROM a"""


@register("loess_curve", _CURVE)
def loess(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double")
    lines = table(spark, folder, "lineitem").select("l_returnflag", day.alias("day"), "l_extendedprice")
    curve = loess_curve(lines, "day", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(curve, ["x"], 6), ["smooth"], 3)


_PLACES = 16
# The local fits at the places of the grid as weights of the observations: V (value, slope) by place; B blends them.
_OPERATOR = f"""d AS (SELECT row_number() OVER (ORDER BY yr, mon) AS i, (yr - 1995) * 12.0 + mon AS x, avg(o_totalprice) AS y
 FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon, o_totalprice FROM orders) GROUP BY yr, mon),
e AS (SELECT min(x) AS low, max(x) AS high, count(*) AS total, (max(x) - min(x)) / {_PLACES - 1} AS g FROM d),
p AS (SELECT point, low + (high - low) * point / {_PLACES - 1} AS x0, floor(total * 0.75 + 0.00001) AS q FROM e, (SELECT unnest(range(0, {_PLACES})) AS point)),
o AS (SELECT point, x0, q, i, x, y, abs(x - x0) AS dist, count(*) OVER (PARTITION BY point ORDER BY abs(x - x0)) AS after FROM d, p),
h AS (SELECT point, min(dist) AS reach FROM o WHERE after >= q GROUP BY point),
w AS (SELECT o.point, x0, i, y, reach, (x - x0) / reach AS s, CASE WHEN dist < reach THEN pow(1 - pow(dist / reach, 3), 3) ELSE 0 END AS w
 FROM o JOIN h ON o.point = h.point),
a AS (SELECT point, first(x0) AS x, first(reach) AS reach, sum(w) AS s0, sum(w * s) AS s1, sum(w * s * s) AS s2, sum(w * s * s * s) AS s3,
 sum(w * s * s * s * s) AS s4 FROM w GROUP BY point),
c AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM a),
v AS (SELECT w.point, i, y, x AS x0, w * ((s2 * s4 - s3 * s3) + s * (s2 * s3 - s1 * s4) + s * s * (s1 * s3 - s2 * s2)) / det AS value,
 w * ((s2 * s3 - s1 * s4) + s * (s0 * s4 - s2 * s2) + s * s * (s1 * s2 - s0 * s3)) / det / c.reach AS slope
 FROM w JOIN c ON w.point = c.point),
f AS (SELECT point, first(x0) AS x, sum(value * y) AS smooth, sum(slope * y) AS slope, sum(value * value) AS norm FROM v GROUP BY point),
cell AS (SELECT i, x, y, g, least(CAST(floor((x - low) / g) AS INTEGER), {_PLACES - 2}) AS k, low FROM d, e),
b AS (SELECT i, x, y, k, g, (x - (low + g * k)) / g AS t FROM cell)"""


@register("loess_band", f"""WITH {_OPERATOR},
l AS (SELECT b.i, lo.i AS j, (1 + 2 * t) * (1 - t) * (1 - t) * lo.value + t * t * (3 - 2 * t) * hi.value
  + g * (t * (1 - t) * (1 - t) * lo.slope + t * t * (t - 1) * hi.slope) AS l
 FROM b JOIN v lo ON lo.point = b.k JOIN v hi ON hi.point = b.k + 1 AND hi.i = lo.i),
r AS (SELECT i, j, CASE WHEN i = j THEN 1 ELSE 0 END - l AS r FROM l),
rr AS (SELECT a.i, b.i AS j, sum(a.r * b.r) AS m FROM r a JOIN r b ON a.j = b.j GROUP BY ALL),
deltas AS (SELECT sum(CASE WHEN i = j THEN m ELSE 0 END) AS d1, sum(m * m) AS d2 FROM rr),
res AS (SELECT r.i, sum(r.r * d.y) AS e FROM r JOIN d ON d.i = r.j GROUP BY r.i),
s AS (SELECT sqrt(sum(e * e) / max(d1)) AS sigma, max(d1) * max(d1) / max(d2) AS df FROM res, deltas)
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(smooth, 3) AS smooth, round(sigma * sqrt(norm), 3) AS se,
 round(df, 6) AS df, round(smooth - {t_quantile_975('df')} * sigma * sqrt(norm), 1) AS lower,
 round(smooth + {t_quantile_975('df')} * sigma * sqrt(norm), 1) AS upper FROM f, s""")
def loess_band(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly mean price with its smooth curve and 95 % band."""
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"), "o_totalprice")
    monthly = orders.groupBy(((F.col("yr") - 1995) * 12.0 + F.col("mon")).cast("double").alias("month")).agg(F.avg("o_totalprice").alias("price"))
    band = smoothed_band(monthly, "month", "price", points=_PLACES).drop("sigma")
    return rounded(rounded(rounded(band, ["x", "df"], 6), ["smooth", "se"], 3), ["lower", "upper"], 1)


@register("loess_residuals", f"""WITH {_OPERATOR}
SELECT CAST(b.x AS INTEGER) AS month, round((1 + 2 * t) * (1 - t) * (1 - t) * lo.smooth + t * t * (3 - 2 * t) * hi.smooth
 + g * (t * (1 - t) * (1 - t) * lo.slope + t * t * (t - 1) * hi.slope), 3) AS smooth
FROM b JOIN f lo ON lo.point = b.k JOIN f hi ON hi.point = b.k + 1""")
def loess_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """The smoother's value at every month, blended from the places of the grid."""
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"), "o_totalprice")
    month = ((F.col("yr") - 1995) * 12 + F.col("mon")).cast("int").alias("month")
    monthly = orders.groupBy(month).agg(F.avg("o_totalprice").alias("price"))
    return rounded(loess_values(monthly, "month", "price", points=_PLACES).select("month", "smooth"), ["smooth"], 3)


@register("loess_with_nan", _CURVE.replace("FROM lineitem GROUP BY 1, 2", "FROM lineitem WHERE l_linenumber <> 2 AND l_linenumber <> 5 GROUP BY 1, 2"))
def loess_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """NaN in x or y counts as missing in the smoother."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double")
    nan = F.lit(float("nan"))
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", F.when(F.col("l_linenumber") == 5, nan).otherwise(day).alias("day"),
        F.when(F.col("l_linenumber") == 2, nan).otherwise(F.col("l_extendedprice")).alias("price"))
    return rounded(rounded(loess_curve(lines, "day", "price", ["l_returnflag"]), ["x"], 6), ["smooth"], 3)


@register("trend_band_with_nan", ORACLES["trend_band"].replace("FROM lineitem GROUP BY", "FROM lineitem WHERE l_linenumber NOT IN (2, 5) GROUP BY"))
def trend_band_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """A NaN in either column neither spoils the fit nor stretches its grid."""
    nan = F.lit(float("nan"))
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", F.when(F.col("l_linenumber") == 5, nan).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_linenumber") == 2, nan).otherwise(F.col("l_extendedprice")).alias("price"))
    band = trend.trend_band(lines, "quantity", "price", ["l_returnflag"])
    return rounded(rounded(rounded(band, ["x"], 6), ["se"], 4), ["fitted", "lower", "upper"], 3)
