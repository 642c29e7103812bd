"""Regression, variance analysis, correlation and components of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.operators import linear, pca, reshape
from isotrend.operators.moments import result_keys
from isotrend.plans.sql_text import f3_p_value, inverse3, t_p_value
from isotrend.plans.tables import registrar, rounded, table

QUERIES, ORACLES, register = registrar()
PREDICTORS = ["l_quantity", "l_discount", "l_tax"]
MEASURES = ["l_quantity", "l_extendedprice", "charge"]


def charged(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the amount charged, which moves with the price."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, folder, "lineitem").withColumn("charge", charge)


CHARGED = "charged AS (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"


def _moments_sql(source: str, y: str, xs: list[str], group: str = "") -> str:
    """Centred products of y and three predictors, and the solved model."""
    pairs = {"11": (0, 0), "12": (0, 1), "13": (0, 2), "22": (1, 1), "23": (1, 2), "33": (2, 2)}
    s = ", ".join(f"covar_pop({xs[i]}, {xs[j]}) * count(*) AS s{k}" for k, (i, j) in pairs.items())
    t = ", ".join(f"covar_pop({y}, {x}) * count(*) AS t{i}" for i, x in enumerate(xs, 1))
    means = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(xs, 1))
    key, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    inverse = inverse3({k: f"s{k}" for k in pairs})
    return f"""mom AS (SELECT {key}count(*) AS n, avg({y}) AS my, var_pop({y}) * count(*) AS sst, {means}, {s}, {t}
 FROM {source} {by}),
inv AS (SELECT *, {inverse} FROM mom),
beta AS (SELECT *, i11 * t1 + i12 * t2 + i13 * t3 AS b1, i12 * t1 + i22 * t2 + i23 * t3 AS b2,
 i13 * t1 + i23 * t2 + i33 * t3 AS b3 FROM inv),
fit AS (SELECT *, sst - b1 * t1 - b2 * t2 - b3 * t3 AS sse, n - 4 AS dfr, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0,
 (sst - b1 * t1 - b2 * t2 - b3 * t3) / (n - 4) AS mse FROM beta)"""


def _terms_sql(xs: list[str], group: str = "") -> str:
    key = f"{group}, " if group else ""
    shift = ("(m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33"
             " + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23))")
    rows = [f"""SELECT {key}n, dfr, mse, sse, sst, 0 AS position, '(Intercept)' AS term, b0 AS estimate,
 sqrt(mse * (1.0 / n + {shift})) AS se, CAST(0 AS DOUBLE) AS std, NULL AS vif, NULL AS ss FROM fit"""]
    for i, x in enumerate(xs, 1):
        rows.append(f"""SELECT {key}n, dfr, mse, sse, sst, {i}, '{x}', b{i}, sqrt(mse * i{i}{i}),
 b{i} * sqrt(s{i}{i} / sst), s{i}{i} * i{i}{i}, b{i} * b{i} / i{i}{i} FROM fit""")
    return "terms AS (" + "\n UNION ALL ".join(rows) + ")"


_OLS = f"WITH {_moments_sql('lineitem', 'l_extendedprice', PREDICTORS)}, {_terms_sql(PREDICTORS)}"
_OLS_COLUMNS = f"""CAST(position AS INTEGER) AS position, term, round(estimate, 5) AS estimate, round(se, 5) AS std_error,
 round(estimate / se, 5) AS t, round({t_p_value('(estimate / se)', 'dfr')}, 6) AS p"""


def _shown_terms(models: DataFrame, keys: list[str]) -> DataFrame:
    shown = linear.coefficients(models, keys).select(*result_keys(keys), "position", "term", "estimate", "std_error", "t", "p")
    return rounded(rounded(shown, ["estimate", "std_error", "t"], 5), ["p"], 6)


@register("ols_multi", f"{_OLS} SELECT {_OLS_COLUMNS} FROM terms")
def ols_multi(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_terms(linear.ols(table(spark, folder, "lineitem"), "l_extendedprice", PREDICTORS), [])


@register("ols_by_group", f"""WITH {_moments_sql('lineitem', 'l_extendedprice', PREDICTORS, 'l_suppkey')},
{_terms_sql(PREDICTORS, 'l_suppkey')} SELECT l_suppkey, {_OLS_COLUMNS} FROM terms""")
def ols_by_group(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return _shown_terms(linear.ols(lines, "l_extendedprice", PREDICTORS, ["l_suppkey"]), ["l_suppkey"])


_ODD = """odd AS (SELECT l_returnflag AS flag, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price, l_quantity, l_discount, l_tax
 FROM lineitem), whole AS (SELECT * FROM odd WHERE price IS NOT NULL)"""


@register("ols_odd_names", f"""WITH {_ODD}, {_moments_sql('whole', 'price', PREDICTORS, 'flag')},
{_terms_sql(PREDICTORS, 'flag')} SELECT flag, {_OLS_COLUMNS.replace(' term,', " replace(term, 'l_tax', 'Total.1') AS term,")} FROM terms""")
def ols_odd_names(spark: SparkSession, folder: str) -> DataFrame:
    """A key called ``n``, a predictor with a dot in its name, and NaN where a price is missing."""
    price = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).otherwise(float("nan"))
    lines = table(spark, folder, "lineitem").withColumn("my price", price) \
        .withColumnsRenamed({"l_returnflag": "n", "l_tax": "Total.1"})
    models = linear.ols(lines, "my price", [*PREDICTORS[:-1], "Total.1"], ["n"])
    return _shown_terms(models, ["n"]).withColumnRenamed("n_key", "flag")


@register("ols_standardised", f"""{_OLS} SELECT term, round(std, 8) AS std_estimate, round(std * se / estimate, 8) AS std_estimate_error
FROM terms WHERE position > 0""")
def ols_standardised(spark: SparkSession, folder: str) -> DataFrame:
    models = linear.ols(table(spark, folder, "lineitem"), "l_extendedprice", PREDICTORS)
    return rounded(linear.coefficients(models).filter("position > 0").select("term", "std_estimate", "std_estimate_error"),
                   ["std_estimate", "std_estimate_error"], 8)


_F = "((sst - sse) / 3 / mse)"


@register("model_tests", f"""WITH {_moments_sql('lineitem', 'l_extendedprice', PREDICTORS)}
SELECT CAST(n AS BIGINT) AS n, CAST(dfr AS BIGINT) AS df_resid, round(1 - sse / sst, 10) AS r2,
 round(1 - sse / sst * (n - 1) / dfr, 10) AS adj_r2, round(sqrt(mse), 4) AS sigma, round({_F}, 6) AS f,
 round({f3_p_value(_F, 'dfr')}, 6) AS f_p FROM fit""")
def model_tests(spark: SparkSession, folder: str) -> DataFrame:
    models = linear.ols(table(spark, folder, "lineitem"), "l_extendedprice", PREDICTORS)
    shown = linear.model_tests(models).drop("df_model")
    return rounded(rounded(rounded(shown, ["r2", "adj_r2"], 10), ["sigma"], 4), ["f", "f_p"], 6)


@register("anova_table", f"""{_OLS}, lines AS (
 SELECT 0 AS position, 'Model' AS source, sst - sse AS ss, 3 AS df, {_F} AS f, 1 - sse / sst AS pre,
  {f3_p_value(_F, 'dfr')} AS p FROM fit
 UNION ALL SELECT position, term, ss, 1, ss / mse, ss / (ss + sse), {t_p_value('sqrt(ss / mse)', 'dfr')} FROM terms WHERE position > 0
 UNION ALL SELECT 4, 'Error', sse, dfr, NULL, NULL, NULL FROM fit
 UNION ALL SELECT 5, 'Total', sst, n - 1, NULL, NULL, NULL FROM fit)
SELECT CAST(position AS INTEGER) AS position, source, round(ss / 1000, 0) AS kilo_ss, CAST(df AS BIGINT) AS df,
 round(f, 6) AS f, round(pre, 10) AS pre, round(p, 6) AS p FROM lines""")
def anova_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = linear.anova_table(linear.ols(table(spark, folder, "lineitem"), "l_extendedprice", PREDICTORS))
    shown = rows.select("position", "source", F.round(F.col("ss") / 1000, 0).alias("kilo_ss"), "df", "f", "pre", "p")
    return rounded(rounded(shown, ["f", "p"], 6), ["pre"], 10)


_VIF = f"WITH {CHARGED}, {_moments_sql('charged', 'l_tax', MEASURES)}, {_terms_sql(MEASURES)}"


@register("vif", f"{_VIF} SELECT term, round(vif, 4) AS vif FROM terms WHERE position > 0")
def vif(spark: SparkSession, folder: str) -> DataFrame:
    models = linear.ols(charged(spark, folder), "l_tax", MEASURES)
    return rounded(linear.vif_table(models).select("term", "vif"), ["vif"], 4)


def _pairs_sql(columns: list[str]) -> str:
    rows = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            rows.append(f"""SELECT '{a}' AS first, '{b}' AS second, CAST(count(*) AS BIGINT) AS n, corr({a}, {b}) AS r, avg({a}) AS first_mean,
 stddev_samp({a}) AS first_sd, avg({b}) AS second_mean, stddev_samp({b}) AS second_sd FROM charged""")
    return f"WITH {CHARGED}, pairs AS (" + "\n UNION ALL ".join(rows) + ")"


@register("corr_table", f"""{_pairs_sql(MEASURES)}
SELECT first, second, n, round(r, 8) AS r, round(first_mean, 4) AS first_mean, round(first_sd, 4) AS first_sd,
 round(second_mean, 4) AS second_mean, round(second_sd, 4) AS second_sd,
 round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 8) AS ci_low,
 round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 8) AS ci_high FROM pairs""")
def corr_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = linear.correlations(charged(spark, folder), MEASURES).drop("df", "t", "p")
    rows = rounded(rows, ["r", "ci_low", "ci_high"], 8)
    return rounded(rows, ["first_mean", "first_sd", "second_mean", "second_sd"], 4)


@register("corr_test", f"""WITH c AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r
 FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, CAST(n - 2 AS BIGINT) AS df, round(r, 8) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t,
 round({t_p_value('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p FROM c""")
def corr_test(spark: SparkSession, folder: str) -> DataFrame:
    rows = linear.correlations(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return rounded(rounded(rows.select("l_returnflag", "df", "r", "t", "p"), ["r"], 8), ["t", "p"], 6)


@register("zscore", """SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part))
 / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS p_retailprice_z,
 round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS p_size_z FROM part""")
def zscore(spark: SparkSession, folder: str) -> DataFrame:
    rows = linear.zscore(table(spark, folder, "part"), ["p_retailprice", "p_size"])
    return rounded(rows.select("p_partkey", "p_retailprice_z", "p_size_z"), ["p_retailprice_z", "p_size_z"], 6)


@register("zscore_by_group", """SELECT c_custkey, c_mktsegment, round((c_acctbal - avg(c_acctbal) OVER w)
 / stddev_samp(c_acctbal) OVER w, 6) AS c_acctbal_z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def zscore_by_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = linear.zscore(table(spark, folder, "customer"), ["c_acctbal"], ["c_mktsegment"])
    return rounded(rows.select("c_custkey", "c_mktsegment", "c_acctbal_z"), ["c_acctbal_z"], 6)


def _pca_sql() -> str:
    """Eigenvalues of the 3 × 3 correlation matrix by the trigonometric formula, vectors by cross products."""
    a, b, c = MEASURES
    values = ", ".join(f"1 + 2 * p * cos(phi + {k} * pi() / 3) AS e{i}" for i, k in ((1, 0), (2, 4), (3, 2)))
    vectors = []
    for i in (1, 2, 3):
        d = f"(1 - e{i})"
        vectors.append(f"""SELECT {i} AS component, n, e{i} AS e, (e1 + e2 + e3) AS whole, my, ma, mb, mc, sy, sa, sb, sc, ya, yb, yc,
 r12 * r23 - r13 * {d} AS x, r12 * r13 - {d} * r23 AS y, {d} * {d} - r12 * r12 AS z FROM eig""")
    stacked = "\n UNION ALL ".join(vectors)
    return f"""WITH {CHARGED}, r AS (SELECT count(*) AS n, corr({a}, {b}) AS r12, corr({a}, {c}) AS r13, corr({b}, {c}) AS r23,
 avg(l_tax) AS my, avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc, stddev_samp(l_tax) AS sy, stddev_samp({a}) AS sa,
 stddev_samp({b}) AS sb, stddev_samp({c}) AS sc, covar_samp(l_tax, {a}) AS ya, covar_samp(l_tax, {b}) AS yb,
 covar_samp(l_tax, {c}) AS yc FROM charged),
q AS (SELECT *, sqrt((r12 * r12 + r13 * r13 + r23 * r23) / 3) AS p FROM r),
g AS (SELECT *, acos(least(greatest(r12 * r13 * r23 / (p * p * p), -1), 1)) / 3 AS phi FROM q),
eig AS (SELECT *, {values} FROM g),
raw AS ({stacked}),
turned AS (SELECT *, sqrt(x * x + y * y + z * z) * CASE WHEN x < 0 THEN -1 ELSE 1 END AS norm FROM raw),
pcs AS (SELECT component, n, e * (n - 1) / n AS eigenvalue, e / whole AS share, x / norm AS la, y / norm AS lb, z / norm AS lc,
 my, ma, mb, mc, sy, sa, sb, sc, ya / sa AS ya, yb / sb AS yb, yc / sc AS yc, e FROM turned)"""


@register("pca_scree", f"""{_pca_sql()} SELECT CAST(component AS INTEGER) AS component, round(eigenvalue, 8) AS eigenvalue,
 round(share * 100, 6) AS percent, round(100 * sum(share) OVER (ORDER BY component), 6) AS cumulative_percent FROM pcs""")
def pca_scree(spark: SparkSession, folder: str) -> DataFrame:
    rows = pca.scree(pca.pca(charged(spark, folder), MEASURES))
    return rounded(rounded(rows, ["eigenvalue"], 8), ["percent", "cumulative_percent"], 6)


_VARIABLES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(MEASURES))


@register("pca_loadings", f"""{_pca_sql()}, long AS (
 SELECT component, eigenvalue, variable, CASE idx WHEN 0 THEN la WHEN 1 THEN lb ELSE lc END AS loading
 FROM pcs, (VALUES {_VARIABLES}) v(idx, variable))
SELECT CAST(component AS INTEGER) AS component, variable, round(loading, 6) AS loading,
 round(loading * sqrt(eigenvalue), 6) AS coordinate, round(loading * loading * eigenvalue, 6) AS cos2 FROM long""")
def pca_loadings(spark: SparkSession, folder: str) -> DataFrame:
    rows = pca.variable_map(pca.pca(charged(spark, folder), MEASURES), MEASURES)
    return rounded(rows, ["loading", "coordinate", "cos2"], 6)


@register("pca_cos2", f"""{_pca_sql()}, long AS (
 SELECT component, eigenvalue, variable, CASE idx WHEN 0 THEN la WHEN 1 THEN lb ELSE lc END AS loading
 FROM pcs, (VALUES {_VARIABLES}) v(idx, variable))
SELECT variable, round(sum(loading * loading * eigenvalue), 6) AS cos2 FROM long WHERE component <= 2 GROUP BY variable""")
def pca_cos2(spark: SparkSession, folder: str) -> DataFrame:
    rows = pca.cos2_total(pca.variable_map(pca.pca(charged(spark, folder), MEASURES), MEASURES))
    return rounded(rows, ["cos2"], 6)



@register("pca_scores", f"""{_pca_sql()}, one AS (SELECT max(ma) AS ma, max(sa) AS sa, max(mb) AS mb, max(sb) AS sb, max(mc) AS mc, max(sc) AS sc,
 {', '.join(f"max(CASE WHEN component = {i} THEN l{v} END) AS l{v}{i}" for i in (1, 2, 3) for v in "abc")} FROM pcs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 {', '.join(f"round((l_quantity - ma) / sa * la{i} + (l_extendedprice - mb) / sb * lb{i} + (charge - mc) / sc * lc{i}, 4) AS score_{i}" for i in (1, 2, 3))}
FROM charged, one""")
def pca_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = pca.scores(charged(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *MEASURES),
                      MEASURES)
    return rounded(rows.drop(*MEASURES), ["score_1", "score_2", "score_3"], 4)


def _pcr_sql(used: int) -> str:
    """Scores are uncorrelated, so each coefficient is a covariance over a variance."""
    return f"""{_pca_sql()}, slopes AS (SELECT component, n, my, sy, e, (ya * la + yb * lb + yc * lc) / e AS b FROM pcs
 WHERE component <= {used}),
total AS (SELECT max(n) AS n, max(my) AS my, (max(n) - 1) * (max(sy * sy) - sum(b * b * e)) / (max(n) - {used + 1}) AS mse,
 max(n) - {used + 1} AS dfr FROM slopes),
terms AS (SELECT component AS position, 'score_' || component AS term, b AS estimate,
 sqrt(mse / (slopes.n - 1) / e) AS se, dfr FROM slopes, total
 UNION ALL SELECT 0, '(Intercept)', my, sqrt(mse / n), dfr FROM total)
SELECT CAST(position AS INTEGER) AS position, term, round(estimate, 9) AS estimate, round(se, 9) AS std_error,
 round(estimate / se, 5) AS t, round({t_p_value('(estimate / se)', 'dfr')}, 6) AS p FROM terms"""


def _pcr(spark: SparkSession, folder: str, used: int) -> DataFrame:
    models = pca.pcr(charged(spark, folder), "l_tax", MEASURES, used)
    shown = linear.coefficients(models).select("position", "term", "estimate", "std_error", "t", "p")
    return rounded(rounded(rounded(shown, ["estimate", "std_error"], 9), ["t"], 5), ["p"], 6)


@register("pcr", _pcr_sql(3))
def pcr(spark: SparkSession, folder: str) -> DataFrame:
    return _pcr(spark, folder, 3)


@register("pcr_two_scores", _pcr_sql(2))
def pcr_two_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _pcr(spark, folder, 2)


_NAN_MEASURES = """m AS (SELECT CASE WHEN l_linenumber <> 2 THEN l_quantity END AS l_quantity,
 CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS l_extendedprice, l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)"""


def with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with NaN for some quantities and prices, under names that need care."""
    nan = F.lit(float("nan"))
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") == 2, nan).otherwise(F.col("l_quantity")).alias("the.quantity"),
        F.when(F.col("l_linenumber") == 5, nan).otherwise(F.col("l_extendedprice")).alias("price"), F.col("l_returnflag").alias("n"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@register("corr_with_nan", f"""WITH {_NAN_MEASURES}, c AS (SELECT l_returnflag, count(*) FILTER (l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) AS n,
 corr(l_quantity, l_extendedprice) AS r, avg(CASE WHEN l_extendedprice IS NOT NULL THEN l_quantity END) AS first_mean FROM m GROUP BY 1)
SELECT l_returnflag AS n_key, CAST(n AS BIGINT) AS n, round(r, 8) AS r, round(first_mean, 6) AS first_mean FROM c""")
def corr_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """NaN counts as missing in a correlation; a key named ``n`` and a measure with a dot."""
    rows = linear.correlations(with_nan(spark, folder), ["the.quantity", "price"], ["n"])
    return rounded(rounded(rows.select("n_key", "n", "r", "first_mean"), ["r"], 8), ["first_mean"])


@register("zscore_with_nan", f"""WITH {_NAN_MEASURES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round((l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w, 6) AS quantity_z FROM m WINDOW w AS (PARTITION BY l_returnflag)""")
def zscore_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """A NaN has no z-score and leaves those of the others alone."""
    rows = linear.zscore(with_nan(spark, folder), ["the.quantity"], ["n"])
    shown = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("`the.quantity_z`").alias("quantity_z"))
    return rounded(shown, ["quantity_z"])


@register("describe_with_nan", f"""WITH {_NAN_MEASURES}, q AS (SELECT 'the.quantity' AS measure, l_quantity AS v FROM m UNION ALL SELECT 'price', l_extendedprice FROM m)
SELECT measure, CAST(count(v) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS low, max(v) AS high FROM q GROUP BY measure""")
def describe_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reshape.describe_measures(with_nan(spark, folder), ["the.quantity", "price"]), ["mean", "sd"])
