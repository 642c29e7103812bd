"""Values at the ends of their ranges, odd names and NaN."""

import math

import pytest
from pyspark.sql import functions as F

from isotrend.functions.distributions import f_upper_p, t_two_sided_p
from isotrend.functions.values import number_text
from isotrend.operators import change, linear, pca, reshape, smooth, trend
from isotrend.operators.order_stats import exact_quantiles


@pytest.mark.parametrize("dated", [False, True])
def test_the_last_year_counts(spark, dated):
    rows = [("a", y, float(y)) for y in (1899, 1900, 9998, 9999)]
    df = spark.createDataFrame(rows, "k string, year int, v double")
    year = "year"
    if dated:
        df, year = df.withColumn("day", F.make_date("year", F.lit(12), F.lit(31))), "day"
    for since, want in ((1900, [1900, 9998, 9999]), (9999, [9999])):
        assert sorted(r.year for r in change.entity_year_mean(df, "k", year, "v", since).collect()) == want
    if dated:
        changed = change.period_change(df, "k", "day", "v", 9998, 9999, month=12).first()
        assert (changed.baseline, changed.value) == (9998.0, 9999.0)


@pytest.mark.parametrize(("value", "text"), [
    (1e27, "1e+27"), (math.inf, "Inf"), (-math.inf, "-Inf"), (1e-13, "1e-13"), (20.0, "20"), (0.5, "0.5"), (-0.0, "0"),
    (12345678.9, "12345678.9"), (1e-5, "0.00001"), (1050.0, "1050"), (0.1 + 0.2, "0.30000000000000004"), (None, None)])
def test_every_number_prints(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(number_text("v")).first()[0] == text


@pytest.mark.parametrize("dof", [1e7, 3e9, 1e12, 1e15])
def test_tails_of_huge_samples(spark, dof):
    df = spark.createDataFrame([(t, dof) for t in (0.5, 1.96, 4.0)], "t double, n double")
    for r in df.select("t", t_two_sided_p("t", "n").alias("p"), f_upper_p("t * t", "2", "n").alias("f")).collect():
        # The next term of the expansion in 1/dof.
        normal = math.erfc(r.t / math.sqrt(2))
        density = math.exp(-r.t ** 2 / 2) / math.sqrt(2 * math.pi)
        assert r.p == pytest.approx(normal + density * (r.t ** 3 + r.t) / (2 * dof), rel=1e-11)
        assert r.f == pytest.approx((1 + 2 * r.t ** 2 / dof) ** (-dof / 2) if dof < 1e9 else math.exp(-r.t ** 2), rel=1e-7)


def test_tails_meet_where_the_formula_changes(spark):
    df = spark.createDataFrame([(0.999e6,), (1.001e6,)], "n double")
    low, high = (r.p for r in df.select(t_two_sided_p("2.0D", "n").alias("p")).orderBy("n").collect())
    assert low == pytest.approx(high, rel=1e-7) and low > high


@pytest.mark.parametrize("ranked", [10_000, 50])
def test_nan_is_missing_in_quantiles(spark, monkeypatch, ranked):
    from isotrend.operators import order_stats

    monkeypatch.setattr(order_stats, "RANKED_ROWS", ranked)
    df = spark.range(201).select(F.lit("k").alias("v"), F.when(F.col("id") == 0, float("nan")).otherwise(F.col("id") * 1.0).alias("fit"))
    row = exact_quantiles(df.withColumnRenamed("v", "g"), "fit", (0.0, 0.5, 1.0), ["g"]).first()
    assert tuple(row)[1:] == pytest.approx((1.0, 100.5, 200.0), rel=0.01 if ranked == 50 else 1e-12)


def test_nan_is_missing_in_models_and_means(spark):
    nan = float("nan")
    clean = [("a", float(x), 2.0 * x + (x % 3)) for x in range(20)]
    df = spark.createDataFrame([*clean, ("a", nan, 1.0), ("a", 3.0, nan), ("a", None, 1.0)], "k string, x double, y double")
    good = spark.createDataFrame(clean, "k string, x double, y double")
    for fit in (lambda d: trend.trend_fit(d, "x", "y", ["k"]).select("n", "slope", "r2"),
                lambda d: linear.model_tests(linear.ols(d, "y", ["x"], ["k"]), ["k"]),
                lambda d: pca.scree(pca.pca(d, ["x", "y"], ["k"]), ["k"])):
        assert [tuple(r) for r in fit(df).collect()] == [pytest.approx(tuple(r)) for r in fit(good).collect()]
    means = df.groupBy("k").agg(reshape.mean_of("y").alias("m"), reshape.strict_mean("y").alias("s")).first()
    assert means.m == pytest.approx((sum(r[2] for r in clean) + 2) / 22) and means.s is None


@pytest.mark.parametrize("key", ["Total.1", "my key", "class", "_k", "n", "fit", "v", "term"])
def test_any_key_name_will_do(spark, key):
    rows = [(g, float(x), float((x * 7 + g) % 11), float(x * x % 5)) for g in (1, 2) for x in range(30)]
    df = spark.createDataFrame(rows, ["g", "change...", "fit.1", "y"]).withColumnRenamed("g", key)
    xs = ["change...", "fit.1"]
    plain = spark.createDataFrame(rows, ["g", "a", "b", "y"])
    want = {(r.g, r.position): r.estimate for r in linear.coefficients(linear.ols(plain, "y", ["a", "b"], ["g"]), ["g"]).collect()}
    models = linear.ols(df, "y", xs, [key])
    name = "n_key" if key == "n" else "term_key" if key == "term" else key
    got = {(r[name], r.position): r.estimate for r in linear.coefficients(models, [key]).collect()}
    assert got == pytest.approx(want)
    assert linear.anova_table(models, [key]).count() == 10 and linear.vif_table(models, [key]).count() == 4
    assert pca.scree(pca.pca(df, xs, [key]), [key]).count() == 4
    scored = pca.scores(df, xs, [key])
    assert scored.columns == [*df.columns, "score_1", "score_2"] and scored.count() == 60
    assert linear.model_tests(pca.pcr(df, "y", xs, 1, [key]), [key]).count() == 2
    assert exact_quantiles(df, "y", (0.5,), [key]).columns == [key, "q0"]


def test_standard_errors_of_scaled_slopes(spark):
    rows = [(float(x), 3.0 * x + (x * 5 % 7)) for x in range(25)]
    df = spark.createDataFrame(rows, "x double, y double")
    scaled = df.select(*[((F.col(c) - df.agg(F.avg(c)).first()[0]) / df.agg(F.stddev_samp(c)).first()[0]).alias(c) for c in "xy"])
    want = trend.trend_fit(scaled, "x", "y").first()
    got = trend.standardised_slope(trend.trend_fit(df, "x", "y")).first()
    assert (got.slope_scaled, got.slope_se_scaled) == pytest.approx((want.slope, want.slope_se))
    term = linear.coefficients(linear.ols(df, "y", ["x"])).orderBy("position").collect()
    assert (term[1].std_estimate, term[1].std_estimate_error) == pytest.approx((want.slope, want.slope_se))
    assert term[0].std_estimate_error == pytest.approx(want.intercept_se)


def test_counts_add_up_and_keep_their_order(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,), ("b",)], "l string")
    got = [tuple(r) for r in reshape.count_domain(df, F.col("l"), ["a", "b"]).collect()]
    assert got == [(1, "a", 0), (2, "b", 2), (3, None, 2)]


def test_an_outlying_x_crowds_no_cell(spark):
    near = spark.range(4000).select((F.col("id") / 4000).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    df = near.unionByName(spark.createDataFrame([(1e6, 1.0)], "x double, y double"))
    curve = smooth.loess_curve(df, "x", "y", points=3).orderBy("point").collect()
    assert curve[0].smooth == pytest.approx(3.0, abs=0.3) and len(curve) == 3
