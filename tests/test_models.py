"""Trends, regressions and components: rules, published figures and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plans import final_plan
from isotrend.operators import linear, pca, smooth, trend
from isotrend.operators.moments import add_merged_total, pair_moments
from isotrend.operators.smooth import loess_curve


def frame(spark, data, schema="g string, x double, y double"):
    return spark.createDataFrame(data, schema)


def one(df):
    return df.collect()[0].asDict()


NOISY = [("a", float(x), 2.0 * x + (x * 7 % 5) - 2) for x in range(12)]


def test_simple_fit_matches_least_squares(spark):
    fit = one(trend.trend_fit(frame(spark, NOISY + [("a", None, 3.0), ("a", 4.0, None)]), "x", "y", ["g"]))
    x, y = np.array([r[1] for r in NOISY]), np.array([r[2] for r in NOISY])
    design = np.column_stack([np.ones_like(x), x])
    (b0, b1), sse = np.linalg.lstsq(design, y, rcond=None)[0], None
    residual = y - b0 - b1 * x
    sse = float(residual @ residual)
    cov = sse / 10 * np.linalg.inv(design.T @ design)
    assert fit["n"] == 12 and fit["dof"] == 10
    assert (fit["slope"], fit["intercept"]) == pytest.approx((b1, b0))
    assert (fit["slope_se"], fit["intercept_se"]) == pytest.approx((cov[1, 1] ** 0.5, cov[0, 0] ** 0.5))
    assert fit["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    assert fit["sigma"] == pytest.approx((sse / 10) ** 0.5)
    assert abs(residual.sum()) < 1e-9


def test_degenerate_groups(spark):
    data = [("two", 1.0, 1.0), ("two", 2.0, 5.0), ("flat x", 1.0, 1.0), ("flat x", 1.0, 2.0), ("flat x", 1.0, 4.0),
            ("flat y", 1.0, 3.0), ("flat y", 2.0, 3.0), ("flat y", 3.0, 3.0), ("perfect", 1.0, 1.0),
            ("perfect", 2.0, 2.0), ("perfect", 3.0, 3.0), ("none", None, None), ("single", 1.0, 1.0)]
    fits = {r.g: r for r in trend.trend_fit(frame(spark, data), "x", "y", ["g"]).collect()}
    assert fits["two"].slope == 4.0 and fits["two"].slope_p is None
    assert fits["flat x"].slope is None and fits["flat x"].slope_p is None
    assert fits["flat y"].slope == 0.0 and fits["flat y"].slope_p is None
    assert fits["perfect"].slope == pytest.approx(1.0) and fits["perfect"].slope_p == 0.0
    assert fits["none"].n == 0 and fits["none"].slope is None
    assert fits["single"].slope is None


MONTHLY = [("up", m, y, y * 1.0 + (y * 3 + k) % 2) for k, m in enumerate(("May", "June")) for y in range(2000, 2012)] \
    + [("down", "May", y, -2.0 * y + (y % 3)) for y in range(2000, 2012)] \
    + [("noise", "May", y, float((y * 7919) % 13)) for y in range(2000, 2012)] \
    + [("pair", "June", 2000, 1.0), ("pair", "June", 2001, 2.0), ("still", "June", 2005, 1.0),
       ("still", "June", 2005, 2.0), ("still", "June", 2005, 5.0), ("lone", "May", 2000, 1.0)] \
    + [("up", "May", 2025, -1e6)]


@pytest.fixture(scope="module")
def tests_of_trend(spark):
    df = spark.createDataFrame(MONTHLY, "e string, m string, y int, v double")
    return df, trend.trend_test(df, "e", "m", "y", "v", [2025])


def test_grouped_models_equal_single_models(spark, tests_of_trend):
    df, tests = tests_of_trend
    found = {(r.e, r.month): r for r in tests.collect()}
    assert ("lone", "May") not in found and ("up", "All Months") in found
    for (entity, month), row in found.items():
        part = df.filter((F.col("e") == entity) & (F.col("y") != 2025))
        if month != "All Months":
            part = part.filter(F.col("m") == month)
        alone = one(trend.trend_fit(part, "y", "v"))
        for name in ("n", "slope", "slope_se", "slope_p", "r2"):
            a, b = getattr(row, name), alone[name]
            assert a == b if a is None or b is None else a == pytest.approx(b, rel=1e-9, abs=1e-12), (entity, month, name)


def test_merged_moments_do_not_lose_digits(spark):
    df = spark.range(4000).select((F.col("id") % 7).alias("part"), (F.col("id") + 1e8).alias("x"),
                                  (F.sin("id") + 1e7).alias("y"), F.lit(1).alias("g"))
    merged = add_merged_total(pair_moments(df, "x", "y", ["g", "part"]).withColumn("part", F.col("part").cast("string")),
                              ["g"], "part", "all").filter("part = 'all'").first()
    direct = pair_moments(df, "x", "y", ["g"]).first()
    scale = {"sxy": (direct.sxx * direct.syy) ** 0.5}
    for name in ("n", "mean_x", "mean_y", "sxx", "syy", "sxy"):
        assert merged[name] == pytest.approx(direct[name], abs=1e-8 * scale.get(name, direct[name]))


def test_significance_tables(spark, tests_of_trend):
    _, tests = tests_of_trend
    by_month = {r.month: tuple(r)[1:] for r in trend.significance_by_month(tests).collect()}
    assert by_month["May"] == (2, 1, 1, 1)
    assert by_month["June"] == (1, 1, 0, 1)  # the two-point group is not significant, the still one is nowhere
    by_entity = {r.e: r for r in trend.significance_by_entity(tests, "e").collect()}
    assert by_entity["up"].positive == 3 and by_entity["up"].slope_diff == 3
    assert by_entity["down"].slope_diff == -2
    assert by_entity["still"].not_significant == 0 and by_entity["pair"].not_significant == 2
    areas = spark.createDataFrame([("up",), ("elsewhere",)], "name string")
    shown = {r.name: r.slope_diff for r in trend.significance_map(areas, tests, "name", "e").collect()}
    assert shown == {"up": 3, "elsewhere": None}


def test_significance_long(tests_of_trend):
    _, tests = tests_of_trend
    by_month = trend.significance_by_month(tests)
    long = trend.significance_long(by_month).collect()
    assert len(long) == 3 * by_month.count()
    assert {r.category for r in long} == set(trend.CATEGORY_NAMES.values())
    assert {(r.month, r.month_ordinal) for r in long} == {(None, None), ("May", 5), ("June", 6)}
    for month in (None, "May", "June"):
        counts = {r.category_ordinal: r["count"] for r in long if r.month == month}
        significant = {r.significant for r in long if r.month == month}
        assert significant == {counts[1] + counts[3]}


def test_trend_test_scans_once(tests_of_trend):
    plan = final_plan(tests_of_trend[1])
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1 and "Expand" not in plan
    assert "Join" not in plan


def test_period_change_scans_once(spark, small):
    from isotrend.operators.change import period_change

    orders = spark.read.parquet(f"{small}/orders.parquet")
    plan = final_plan(period_change(orders, "o_orderpriority", "o_orderdate", "o_totalprice", 1996, 1999))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hash") == 1
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan


def test_trend_delta_rounds_twice(spark):
    fit = spark.createDataFrame([(0.0335, -19.0)], "slope double, intercept double")
    got = one(trend.trend_delta(fit, 1975, 2024))
    assert got["delta"] == pytest.approx(1.642) or got["delta"] == pytest.approx(1.641)
    assert got["per_year"] == pytest.approx(0.034) or got["per_year"] == pytest.approx(0.033)


def test_residual_summary(spark):
    got = one(trend.residual_summary(frame(spark, NOISY), "x", "y", ["g"]))
    x, y = np.array([r[1] for r in NOISY]), np.array([r[2] for r in NOISY])
    slope, intercept = np.polyfit(x, y, 1)
    want = np.quantile(y - intercept - slope * x, [0, 0.25, 0.5, 0.75, 1])
    assert [got[k] for k in ("min", "q1", "median", "q3", "max")] == pytest.approx(list(want), abs=1e-9)
    alone = one(trend.residual_summary(frame(spark, NOISY), "x", "y"))
    assert alone["median"] == pytest.approx(want[2], abs=1e-9)


def test_trend_band(spark):
    band = trend.trend_band(frame(spark, NOISY), "x", "y", ["g"]).orderBy("point").collect()
    assert len(band) == 80 and band[0].x == 0.0 and band[-1].x == 11.0
    fit = one(trend.trend_fit(frame(spark, NOISY), "x", "y", ["g"]))
    assert band[0].fitted == pytest.approx(fit["intercept"])
    assert band[0].se == pytest.approx(fit["intercept_se"])
    assert band[0].upper - band[0].fitted == pytest.approx(2.2281388519649 * fit["intercept_se"])
    narrow = min(band, key=lambda r: r.upper - r.lower)
    assert narrow.x == pytest.approx(5.5, abs=0.1)


# Moments of a yearly temperature series of 45 years, and the correlations of
# year, sea surface anomaly and radiative forcing, with the figures that follow from them.
YEARLY_MOMENTS = (45, 2001.0, 0.0334925340 * 2001 - 19.9041161616, 7590.0, 55.3511666667, 254.2083333333)
DRIVER_CORRELATIONS = (0.8967469261, 0.9987645339, 0.8961529360)


def test_published_simple_fit(spark):
    moments = spark.createDataFrame([YEARLY_MOMENTS], "n long, mean_x double, mean_y double, sxx double, syy double, sxy double")
    fit = one(trend.fit_columns(moments))
    assert fit["slope"] == pytest.approx(0.0334925340, rel=1e-6)
    assert fit["slope_se"] == pytest.approx(0.0119795310, rel=1e-6)
    assert fit["slope_t"] == pytest.approx(2.7958134651, rel=1e-6)
    assert fit["slope_p"] == pytest.approx(0.0077079408, rel=1e-6)
    assert fit["intercept"] == pytest.approx(-19.9041161616, rel=1e-6)
    assert (fit["r2"], fit["adj_r2"]) == pytest.approx((0.1538193641, 0.1341407446), rel=1e-6)


def driver_matrix():
    a, b, c = DRIVER_CORRELATIONS
    return np.array([[1, a, b], [a, 1, c], [b, c, 1]])


def test_published_components_and_inflation():
    from isotrend.operators.linear import solve_model
    from isotrend.operators.pca import components

    values, vectors = components(45, driver_matrix())
    assert list(values) == pytest.approx([2.79836433, 0.13376188, 0.00120712], rel=1e-4)
    assert list(values / values.sum()) == pytest.approx([0.9539878386, 0.0456006423, 0.0004115192], rel=1e-4)
    assert list(vectors[:, 0]) == pytest.approx([0.5845447887, 0.5628067031, 0.5844279297], abs=1e-6)
    assert list(vectors[:, 1]) == pytest.approx([0.3961523962, -0.8265857094, 0.3997741163], abs=1e-5)
    assert list(vectors[:, 2]) == pytest.approx([0.7080753272, -0.0021633516, -0.7061335928], abs=1e-5)
    cross = np.eye(4)
    cross[1:, 1:] = driver_matrix()
    terms = solve_model(45, np.zeros(4), cross, ["year", "sea", "forcing"])["terms"]
    assert [t["vif"] for t in terms[1:]] == pytest.approx([407.38025, 5.10887, 405.17698], rel=1e-4)


def three_predictors(spark, n=400):
    rng = np.random.default_rng(7)
    a = rng.normal(2000, 13, n)
    b = 0.01 * (a - 2000) + rng.normal(0, 0.1, n)
    c = 0.04 * (a - 2000) + rng.normal(0, 0.03, n)
    y = 50 - 0.4 * (a - 2000) + 3.5 * b + 10 * c + rng.normal(0, 1, n)
    data = np.column_stack([a, b, c, y])
    return data, spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, y double")


def test_multiple_regression(spark):
    data, df = three_predictors(spark)
    models = linear.ols(df, "y", ["a", "b", "c"])
    terms = linear.coefficients(models).orderBy("position").collect()
    x, y = np.column_stack([np.ones(len(data)), data[:, :3]]), data[:, 3]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    sse = float(((y - x @ beta) ** 2).sum())
    dof = len(y) - 4
    centred = np.column_stack([np.ones(len(data)), data[:, :3] - data[:, :3].mean(0)])
    cov = sse / dof * np.linalg.inv(centred.T @ centred)
    assert [t.estimate for t in terms] == pytest.approx(list(beta), rel=1e-7)
    assert [t.std_error for t in terms[1:]] == pytest.approx(list(np.sqrt(np.diag(cov))[1:]), rel=1e-7)
    assert all(0 <= t.p <= 1 for t in terms)
    corr = np.corrcoef(data[:, :3].T)
    vif = [r.vif for r in linear.vif_table(models).orderBy("position").collect()]
    assert vif == pytest.approx(list(np.diag(np.linalg.inv(corr))), rel=1e-7)
    scaled = (data - data.mean(0)) / data.std(0, ddof=1)
    std = np.linalg.lstsq(scaled[:, :3], scaled[:, 3], rcond=None)[0]
    assert [t.std_estimate for t in terms[1:]] == pytest.approx(list(std), rel=1e-7)


def test_anova_adds_up(spark):
    _, df = three_predictors(spark)
    table = {r.source: r for r in linear.anova_table(linear.ols(df, "y", ["a", "b", "c"])).collect()}
    assert table["Model"].ss + table["Error"].ss == pytest.approx(table["Total"].ss)
    assert table["Model"].df + table["Error"].df == table["Total"].df == 399
    models = linear.ols(df, "y", ["a", "b", "c"])
    terms = {r.term: r for r in linear.coefficients(models).collect()}
    without = one(linear.ols(df, "y", ["a", "c"]))
    assert table["b"].ss == pytest.approx(without["sse"] - table["Error"].ss, rel=1e-6)
    assert table["b"].p == pytest.approx(terms["b"].p, abs=1e-12)
    assert table["b"].pre == pytest.approx(table["b"].ss / (table["b"].ss + table["Error"].ss))
    assert one(linear.model_tests(models))["f_p"] == table["Model"].p


def test_redundant_predictor_is_left_out(spark):
    _, df = three_predictors(spark)
    df = df.withColumn("twice", F.col("a") * 2 + 1).withColumn("flat", F.lit(3.0))
    models = linear.ols(df, "y", ["a", "twice", "b", "flat"])
    terms = {r.term: r for r in linear.coefficients(models).collect()}
    assert terms["twice"].estimate is None and terms["flat"].estimate is None
    assert one(models)["df_model"] == 2
    plain = {r.term: r for r in linear.coefficients(linear.ols(df, "y", ["a", "b"])).collect()}
    for name in ("a", "b", "(Intercept)"):
        assert terms[name].estimate == pytest.approx(plain[name].estimate, rel=1e-8)


def test_one_predictor_agrees_with_simple_fit(spark):
    df = frame(spark, NOISY)
    simple = one(trend.trend_fit(df, "x", "y"))
    terms = linear.coefficients(linear.ols(df, "y", ["x"])).orderBy("position").collect()
    assert terms[1].estimate == pytest.approx(simple["slope"]) and terms[1].p == pytest.approx(simple["slope_p"])
    assert terms[0].std_error == pytest.approx(simple["intercept_se"])
    scaled = one(trend.standardised_slope(trend.trend_fit(df, "x", "y")))
    assert terms[1].std_estimate == pytest.approx(scaled["slope_scaled"])


def test_grouped_regression_and_missing_rows(spark):
    _, df = three_predictors(spark)
    both = df.withColumn("g", F.when(F.col("a") > 2000, "late").otherwise("early")) \
             .withColumn("b", F.when(F.col("c") < 1, F.col("b")))
    grouped = {(r.g, r.term): r.estimate for r in linear.coefficients(linear.ols(both, "y", ["a", "b"], ["g"]), ["g"]).collect()}
    late = linear.coefficients(linear.ols(both.filter("g = 'late' and b is not null"), "y", ["a", "b"])).collect()
    assert all(grouped[("late", r.term)] == pytest.approx(r.estimate) for r in late)


def test_correlation_table(spark):
    data, df = three_predictors(spark)
    got = {(r["first"], r["second"]): r for r in linear.correlations(df, ["a", "b", "c"]).collect()}
    r = np.corrcoef(data[:, 0], data[:, 1])[0, 1]
    row = got[("a", "b")]
    assert row.r == pytest.approx(r) and row.n == 400 and row.df == 398
    assert row.ci_low == pytest.approx(math.tanh(math.atanh(r) - 1.959963984540054 / math.sqrt(397)))
    assert row.first_mean == pytest.approx(data[:, 0].mean()) and row.first_sd == pytest.approx(data[:, 0].std(ddof=1))
    simple = one(trend.trend_fit(df, "a", "b"))
    assert row.p == pytest.approx(simple["slope_p"], abs=1e-12)
    exact = linear.correlations(df.withColumn("z", F.col("a") * 2), ["a", "z"]).first()
    assert exact.r == pytest.approx(1.0)


def test_zscore(spark):
    df = frame(spark, [("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 7.0, 5.0), ("b", None, 5.0)])
    got = linear.zscore(df, ["x", "y"]).orderBy("x").collect()
    xs = np.array([1.0, 3.0, 7.0])
    want = list((xs - xs.mean()) / xs.std(ddof=1))
    assert [r.x_z for r in got] == pytest.approx([None] + want) or [r.x_z for r in got][1:] == pytest.approx(want)
    assert all(r.y_z is None for r in got)
    grouped = {(r.g, r.x): r.x_z for r in linear.zscore(df, ["x"], ["g"]).collect()}
    assert grouped[("a", 1.0)] == pytest.approx(-math.sqrt(0.5)) and grouped[("b", 7.0)] is None


def test_components(spark):
    data, df = three_predictors(spark)
    fit = pca.pca(df, ["a", "b", "c"]).orderBy("component").collect()
    z = (data[:, :3] - data[:, :3].mean(0)) / data[:, :3].std(0, ddof=1)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    assert [r.eigenvalue for r in fit] == pytest.approx(list(values[::-1]), rel=1e-8)
    assert sum(r.share for r in fit) == pytest.approx(1.0) and fit[-1].cumulative == pytest.approx(1.0)
    for i, row in enumerate(fit):
        assert row.loadings[0] >= 0
        assert np.abs(row.loadings) == pytest.approx(np.abs(vectors[:, ::-1][:, i]), abs=1e-8)
    variables = pca.variable_map(pca.pca(df, ["a", "b", "c"]), ["a", "b", "c"])
    every = {r.variable: r.cos2 for r in pca.cos2_total(variables, (1, 2, 3)).collect()}
    assert every["a"] == pytest.approx(399 / 400)


def test_scores_and_regression_on_them(spark):
    data, df = three_predictors(spark)
    scored = pca.scores(df, ["a", "b", "c"])
    names = ["score_1", "score_2", "score_3"]
    direct = {r.term: r for r in linear.coefficients(linear.ols(scored, "y", names)).collect()}
    models = pca.pcr(df, "y", ["a", "b", "c"])
    short = {r.term: r for r in linear.coefficients(models).collect()}
    for name in names + ["(Intercept)"]:
        assert short[name].estimate == pytest.approx(direct[name].estimate, rel=1e-6)
        assert short[name].p == pytest.approx(direct[name].p, abs=1e-8)
    assert one(models)["r2"] == pytest.approx(one(linear.ols(df, "y", ["a", "b", "c"]))["r2"])
    two = one(pca.pcr(df, "y", ["a", "b", "c"], 2))
    assert two["r2"] < one(models)["r2"] and two["df_model"] == 2


def test_grouped_components_skip_constant_groups(spark):
    _, df = three_predictors(spark)
    df = df.withColumn("g", F.when(F.col("a") > 2000, "late").otherwise("flat")) \
           .withColumn("b", F.when(F.col("g") == "flat", 1.0).otherwise(F.col("b")))
    assert {r.g for r in pca.pca(df, ["a", "b"], ["g"]).collect()} == {"late"}
    scored = pca.scores(df, ["a", "b"], ["g"]).filter("g = 'late'")
    alone = pca.scores(df.filter("g = 'late'"), ["a", "b"])
    assert scored.agg(F.sum(F.abs("score_2"))).first()[0] == pytest.approx(alone.agg(F.sum(F.abs("score_2"))).first()[0])


def plain_loess(x, y, at, span=0.75):
    q = int(len(x) * span + 1e-5)
    out = []
    for x0 in at:
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        design = np.column_stack([np.ones_like(x), x - x0, (x - x0) ** 2]) * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(design, y * np.sqrt(w), rcond=None)[0][0])
    return out


@pytest.mark.parametrize("keys", [["g"], []])
def test_loess_curve(spark, keys):
    x = np.array([0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 12, 15, 15, 20], dtype=float)
    y = np.sin(x / 3) + (x * 7 % 3) / 10
    df = frame(spark, [("a", float(a), float(b)) for a, b in zip(x, y)])
    got = loess_curve(df, "x", "y", keys).orderBy("point").collect()
    at = np.linspace(0, 20, 80)
    assert [r.x for r in got] == pytest.approx(list(at))
    assert [r.smooth for r in got] == pytest.approx(plain_loess(x, y, at), abs=1e-7)


def test_loess_reproduces_a_parabola(spark):
    df = frame(spark, [("a", float(i), i * i - 3.0 * i) for i in range(30)])
    for row in loess_curve(df, "x", "y", ["g"]).collect():
        assert row.smooth == pytest.approx(row.x ** 2 - 3 * row.x, abs=1e-6)


def operator_of(x, places, span=0.75):
    """Value and slope weights of the local fits at the places, for every observation."""
    q = int(len(x) * span + 1e-5)
    value, slope = [], []
    for x0 in places:
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        design = np.column_stack([np.ones_like(x), x - x0, (x - x0) ** 2])
        shares = np.linalg.solve((design * w[:, None]).T @ design, (design * w[:, None]).T)
        value.append(shares[0])
        slope.append(shares[1])
    return np.array(value), np.array(slope)


def blended(at, places, value, slope):
    g = places[1] - places[0]
    k = np.clip(((at - places[0]) / g).astype(int), 0, len(places) - 2)
    t = ((at - places[k]) / g)[:, None]
    return (1 + 2 * t) * (1 - t) ** 2 * value[k] + t ** 2 * (3 - 2 * t) * value[k + 1] \
        + g * (t * (1 - t) ** 2 * slope[k] + t ** 2 * (t - 1) * slope[k + 1])


def noisy(seed, size):
    draw = np.random.default_rng(seed)
    x = np.round(draw.uniform(0, 30, size), 1)
    return x, np.sin(x / 4) + draw.normal(scale=0.3, size=size)


@pytest.mark.parametrize("block", [1024, 7])
def test_loess_band_by_the_whole_operator(spark, monkeypatch, block):
    """σ, degrees and band from the matrix L itself; also with an index of many blocks."""
    monkeypatch.setattr(smooth, "BLOCK", block)
    x, y = noisy(1, 120)
    df = frame(spark, [("a", float(a), float(b)) for a, b in zip(x, y)] + [("b", float("nan"), 1.0), ("a", 1.0, float("nan"))]).repartition(5)
    places = np.linspace(x.min(), x.max(), 20)
    value, slope = operator_of(x, places)
    rest = np.eye(len(x)) - blended(x, places, value, slope)
    inner = rest @ rest.T
    sigma = np.sqrt(((rest @ y) ** 2).sum() / np.trace(inner))
    dof = np.trace(inner) ** 2 / np.trace(inner @ inner)
    got = smooth.loess_band(df, "x", "y", ["g"], points=20).orderBy("point").collect()
    assert len(got) == 20 and {r.g for r in got} == {"a"}
    assert [r.sigma for r in got] == pytest.approx([sigma] * 20, rel=1e-9) and got[0].df == pytest.approx(dof, rel=1e-9)
    se = sigma * np.sqrt((value ** 2).sum(axis=1))
    assert [r.smooth for r in got] == pytest.approx((value @ y).tolist()) and [r.se for r in got] == pytest.approx(se.tolist())
    assert all(r.lower < r.smooth < r.upper and r.upper - r.smooth == pytest.approx(r.smooth - r.lower) for r in got)
    assert [r.smooth for r in loess_curve(df, "x", "y", ["g"], points=20).orderBy("point").collect()] == pytest.approx(plain_loess(x, y, places))


@pytest.mark.parametrize("keys", [["g"], []])
def test_blended_values_and_their_error(spark, keys):
    x, y = noisy(2, 200)
    df = frame(spark, [("a", float(a), float(b)) for a, b in zip(x, y)])
    got = smooth.loess_values(df, "x", "y", keys).select("x", "smooth").collect()
    places = np.linspace(x.min(), x.max(), 80)
    value, slope = operator_of(x, places)
    at = np.array([r.x for r in got])
    assert [r.smooth for r in got] == pytest.approx(blended(at, places, (value @ y)[:, None], (slope @ y)[:, None])[:, 0].tolist())
    # Eighty places leave less than a thousandth of the curve's range between blend and direct fit.
    assert np.abs(np.array([r.smooth for r in got]) - plain_loess(x, y, at)).max() < 1e-3 * np.ptp(y)


def test_smoother_of_many_groups_and_odd_ones(spark):
    draw = np.random.default_rng(4)
    rows = [(f"g{i % 60}", float(draw.integers(0, 40)), float(draw.normal())) for i in range(2400)]
    rows += [("flat", 3.0, 1.0)] * 5 + [("two", 1.0, 1.0), ("two", 2.0, 5.0), (None, 1.0, 2.0), ("none", None, 1.0)]
    got = loess_curve(frame(spark, rows).repartition(6), "x", "y", ["g"], points=5).collect()
    assert len(got) == 5 * 63 and all(r.smooth is None for r in got if r.g in ("flat", "two", None))
    for name in ("g0", "g31"):
        x, y = (np.array([r[i] for r in rows if r[0] == name]) for i in (1, 2))
        want = plain_loess(x, y, np.linspace(x.min(), x.max(), 5))
        assert [r.smooth for r in sorted((r for r in got if r.g == name), key=lambda r: r.point)] == pytest.approx(want)
    assert all(r.se is None for r in smooth.loess_band(frame(spark, rows[-9:]), "x", "y", ["g"], points=5).collect())
    assert loess_curve(frame(spark, []), "x", "y", ["g"]).collect() == []


def test_smoother_shuffles_each_row_once(spark, monkeypatch):
    """No plan explodes the rows by place: what leaves the index is at most a row per block, task and place."""
    x, y = noisy(3, 3000)
    df = frame(spark, [("a", float(a) + i / 1e6, float(b)) for i, (a, b) in enumerate(zip(x, y))])
    plan = final_plan(loess_curve(df, "x", "y", ["g"]))
    assert "Generate" not in plan and plan.count("Scan parquet") <= 3
