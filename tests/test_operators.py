"""Operators on small frames: one test per rule."""

import pytest
from pyspark.sql import functions as F

from plans import final_plan
from isotrend.operators import change, joins, reshape
from isotrend.operators.order_stats import exact_quantiles


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_left_join_matches_missing_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "code int, w string")
    assert rows(joins.left_join(left, right, {"k": "code"}), "v", "w") == [
        (1, "a", "x"), (1, "a", "y"), (None, "b", "z"), (3, "c", None)]
    plain = joins.left_join(left, right, {"k": "code"}, null_safe=False)
    assert (None, "b", None) in rows(plain)


def test_left_join_with_own_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    assert rows(joins.left_join(df, df.groupBy("k").agg(F.avg("v").alias("m")), "k"), "k", "v") == [
        ("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 5.0, 5.0)]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_attach_shuffled_or_broadcast(spark, threshold):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 100 != 1, F.col("id") % 500).alias("k"),
        F.col("id").alias("v"))
    lookup = df.groupBy("k").agg(F.max("v").alias("top"))
    top = {}
    for k, v in rows(df):
        top[k] = max(v, top.get(k, v))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = rows(joins.attach(df, lookup, "k"), "v")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 3000 and all(r[2] == top[r[0]] for r in got) and None in top


def test_join_drivers_and_area_attributes(spark):
    base = spark.createDataFrame([(2000,), (2001,)], "year int")
    heat = spark.createDataFrame([(2000, 1.0)], "year int, heat double")
    sea = spark.createDataFrame([(2001, 2.0)], "year int, sea double")
    assert rows(joins.join_drivers(base, [heat, sea], "year"), "year") == [(2000, 1.0, None), (2001, None, 2.0)]
    areas = spark.createDataFrame([("WA", "geom"), ("DC", "geom"), ("OR", "geom")], "abbr string, shape string")
    temps = spark.createDataFrame([("WA", 50.0)], "state string, temp double")
    shown = joins.area_attributes(areas, temps, {"abbr": "state"}, exclude=F.col("abbr") == "DC")
    assert rows(shown, "abbr") == [("OR", "geom", None), ("WA", "geom", 50.0)]


def test_strict_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, v double")
    got = df.groupBy("k").agg(reshape.strict_mean("v").alias("s"), F.avg("v").alias("m"))
    assert rows(got, "k") == [("a", None, 1.0), ("b", 3.0, 3.0), ("c", None, None)]


def test_wide_and_long_are_inverse(spark):
    long = spark.createDataFrame([("a", 1900, 1.0), ("a", 1901, None), ("b", 1900, 2.0), ("b", 1901, 3.0)],
                                 "e string, y int, v double")
    wide = reshape.to_wide(long, "e", "y", "v", [1900, 1901], "temp")
    assert wide.columns == ["e", "temp1900", "temp1901"]
    back = reshape.to_long(wide, ["e"]).select("e", F.substring("name", 5, 4).cast("int").alias("y"), "value")
    assert rows(back, "e", "y") == rows(long, "e", "y")


def test_column_positions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert reshape.column_range(df, "b", "d") == ["b", "c", "d"]
    assert reshape.drop_positions(df, 0, 2).columns == ["b", "d"]


def test_group_extremes_keep_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("a", None, 4), ("b", None, 5)],
                               "m string, v double, y int")
    assert rows(reshape.group_extremes(df, ["m"], "v"), "y") == [("a", 2.0, 2), ("a", 2.0, 3)]
    assert rows(reshape.group_extremes(df, ["m"], "v", largest=False)) == [("a", 1.0, 1)]


def test_total_beside_groups(spark):
    df = spark.createDataFrame([("a", "May", 1.0), ("a", "June", 3.0), ("b", "May", 5.0)], "e string, m string, v double")
    got = reshape.with_total_group(df, ["e"], "m", [F.avg("v").alias("mean")])
    assert rows(got, "e", "m") == [("a", "All Months", 2.0), ("a", "June", 3.0), ("a", "May", 1.0),
                                   ("b", "All Months", 5.0), ("b", "May", 5.0)]


def test_domain_keeps_empty_bins(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "c string")
    assert rows(reshape.count_domain(df, F.col("c"), ["w", "x"]), "ordinal") == [(1, "w", 0), (2, "x", 2), (3, None, 1)]


def test_stack_fills_missing_columns(spark):
    a = spark.createDataFrame([(2000, 1.0)], "Year int, Anomaly double")
    b = spark.createDataFrame([(2000, 2.0, "King")], "Year int, Anomaly double, County string")
    got = change.tag_and_stack({"Global": a, "Local": b}, {"Global": ("Anomaly", 1.8)}, "Source")
    assert rows(got.select("Year", "Anomaly", "County", "Source"), "Source") == [
        (2000, 1.8, None, "Global"), (2000, 2.0, "King", "Local")]


READINGS = [("King", "1985-10-01", 50.0), ("King", "2024-10-01", 55.0), ("King", "2024-01-01", 40.0),
            ("Pierce", "1985-10-01", 60.0), ("Pierce", "2024-10-01", None), ("Clark", "2024-10-01", 45.0),
            ("Ferry", "1985-10-01", 40.0), ("Ferry", "2024-10-01", 30.0), ("King", "2025-01-01", 99.0)]


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame(READINGS, "county string, day string, tavg double") \
        .withColumn("day", F.to_date("day"))


def test_period_change(readings):
    got = change.period_change(readings, "county", "day", "tavg", 1985, 2024, 10)
    assert rows(got, "county") == [("Ferry", 40.0, 30.0, -10.0, "-10 to -5"), ("King", 50.0, 55.0, 5.0, "5 to 10")]
    whole = change.period_change(readings, "county", "day", "tavg", 1985, 2024)
    assert rows(whole.select("county", "diff"), "county") == [("Ferry", -10.0), ("King", -2.5)]


def test_entity_series(readings):
    got = change.entity_series(readings, "county", "King", "day", "tavg", drop_year=2025)
    assert rows(got) == [(1985, 50.0), (2024, 47.5)]
    assert rows(change.entity_series(readings, "county", "King", "day", "tavg", month=10)) == [(1985, 50.0), (2024, 55.0)]


def test_baseline_anomaly_uses_all_months(spark):
    df = spark.createDataFrame([("a", 1901, 1, 10.0), ("a", 1901, 7, 30.0), ("a", 2005, 1, 25.0)],
                               "e string, y int, m int, v double")
    got = change.baseline_anomaly(df, ["e"], "y", "v", (1901, 2000), F.col("m") == 1)
    assert rows(got.select("y", "anomaly"), "y") == [(1901, -10.0), (2005, 5.0)]
    overall = change.baseline_anomaly(df, [], "y", "v", (1901, 2000))
    assert rows(overall.select("y", "m", "anomaly"), "y", "m") == [(1901, 1, -10.0), (1901, 7, 10.0), (2005, 1, 5.0)]


def test_climatology_anomaly(spark):
    df = spark.createDataFrame([(1991, "May", 1.0), (1992, "May", 3.0), (2024, "May", 5.0), (2024, "June", 1.0)],
                               "y int, m string, v double")
    got = change.climatology_anomaly(df, "m", "y", "v", (1991, 2020))
    assert rows(got.select("y", "m", "anomaly"), "y", "m") == [
        (1991, "May", -1.0), (1992, "May", 1.0), (2024, "June", None), (2024, "May", 3.0)]
    assert "BroadcastHashJoin" in final_plan(got)


YEARLY = [("WA", 1974, 50.0), ("WA", 1975, 51.5), ("WA", 1977, 49.0), ("OR", 1975, 52.0)]


def test_change_frames(spark):
    df = spark.createDataFrame(YEARLY, "state string, y int, t double")
    got = change.change_frames(df, "state", "y", "t", 1974)
    assert rows(got.select("state", "year", "diff", "category", "direction"), "state", "year") == [
        ("OR", 1975, None, None, None), ("WA", 1974, 0.0, "-1 to 0", "hotter"),
        ("WA", 1975, 1.5, "1 to 2", "hotter"), ("WA", 1977, -1.0, "-2 to -1", "colder")]
    one = change.change_vs_reference_year(df, "state", "y", "t", 1977, 1974)
    assert rows(one.select("state", "diff")) == [("WA", -1.0)]


def test_year_over_year_has_gaps(spark):
    df = spark.createDataFrame(YEARLY, "state string, y int, t double")
    got = change.year_over_year(df, "state", "y", "t")
    assert rows(got.select("state", "year", "diff"), "state", "year") == [
        ("OR", 1975, None), ("WA", 1974, None), ("WA", 1975, 1.5), ("WA", 1977, None)]
    three = change.year_over_year(df, "state", "y", "t", gap=3)
    assert ("WA", 1977, -1.0) in rows(three.select("state", "year", "diff"))


def test_percent_change_with_zero_base(spark):
    df = spark.createDataFrame([("May", 1940, -2.0), ("May", 2024, 1.0), ("June", 1940, 0.0), ("June", 2024, 1.0),
                                ("July", 1940, 1.0)], "m string, y int, v double")
    got = change.percent_change(df, "m", "y", "v", 1940, 2024)
    assert rows(got.select("m", "percent_change"), "m") == [("July", None), ("June", None), ("May", 150.0)]


def test_season_slice(spark):
    df = spark.createDataFrame([(2000, "January"), (2000, "May"), (1990, "January")], "y int, m string")
    assert rows(change.season_slice(df, "y", "m", 1995, 2005, "Winter")) == [(2000, "January")]
    assert rows(change.season_slice(df, "y", "m", 1995, 2005, "Rain")) == []


def test_year_snapshot(spark):
    df = spark.createDataFrame(YEARLY, "state string, y int, t double")
    areas = spark.createDataFrame([("WA",), ("CA",)], "abbr string")
    got = change.year_snapshot(df, areas, "abbr", "state", "y", "t", 1974, ((0, 30, 50, 100), ("a", "b", "c")))
    assert rows(got, "abbr") == [("CA", None, None), ("WA", 50.0, "b")]


def test_choice_list_and_description(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,), (1.0,)], "v double")
    assert rows(reshape.choice_list(df, "v")) == [(1.0,), (3.0,), (None,)]
    got = rows(reshape.describe_measures(df, ["v"]))[0]
    assert got[:2] == ("v", 3) and got[2] == pytest.approx(5 / 3) and got[4:] == (1.0, 3.0)


@pytest.mark.parametrize("coarse", [False, True])
def test_exact_quantiles(spark, monkeypatch, coarse):
    from isotrend.operators import order_stats

    if coarse:  # wide brackets from a poor sketch, so that every step has work to do
        for name, value in (("RANKED_ROWS", 200), ("HALF_WIDTH", 0.02), ("ACCURACY", 200), ("CELLS", 8)):
            monkeypatch.setattr(order_stats, name, value)
    skewed = F.pow(F.rand(3) * 10, F.lit(6)).cast("int").cast("double")
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 400, "small").otherwise("other").alias("k"),
        F.when(F.col("id") % 11 == 0, 0.0).otherwise(skewed).alias("v")).checkpoint()
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    want = df.groupBy("k").agg(F.percentile("v", list(probs)).alias("q")).collect()
    got = {r.k: list(r)[1:] for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    for row in want:
        assert got[row.k] == pytest.approx(row.q, rel=1e-12)
    whole = list(exact_quantiles(df, "v", probs).first())
    assert whole == pytest.approx(df.agg(F.percentile("v", list(probs))).first()[0], rel=1e-12)


DATED = [("a", "1974-03-01", 1.0), ("a", "1975-03-01", 4.0), ("b", "1974-12-31", 2.0), ("b", "1976-01-01", 8.0),
         ("b", None, 99.0)]


def test_date_columns_agree_with_year_numbers(spark):
    dated = spark.createDataFrame(DATED, "e string, d string, v double").withColumn("d", F.to_date("d"))
    numbered = dated.withColumn("y", F.year("d")).drop("d")

    def same(build):
        assert rows(build(dated, "d"), *build(dated, "d").columns) == rows(build(numbered, "y"), *build(numbered, "y").columns)

    same(lambda df, y: change.entity_year_mean(df, "e", y, "v", since=1975))
    same(lambda df, y: change.change_frames(df, "e", y, "v", 1974))
    same(lambda df, y: change.change_vs_reference_year(df, "e", y, "v", 1975, 1974))
    same(lambda df, y: change.year_over_year(df, "e", y, "v"))
    same(lambda df, y: change.percent_change(df, "e", y, "v", 1974, 1975))
    same(lambda df, y: change.baseline_anomaly(df, ["e"], y, "v", (1974, 1975)).select("e", "v", "anomaly"))


def test_year_filters_reach_the_scan(spark, small):
    from isotrend.operators.trend import trend_test

    orders = spark.read.parquet(f"{small}/orders.parquet")
    frame = change.change_vs_reference_year(orders, "o_orderpriority", "o_orderdate", "o_totalprice", 2000, 1997)
    tests = trend_test(orders, "o_orderpriority", F.month("o_orderdate"), "o_orderdate", "o_totalprice", [2001])
    for df in (frame, tests):
        pushed = final_plan(df).split("PushedFilters:")[1].split("ReadSchema")[0]
        assert "LessThan(o_orderdate," in pushed


def test_lattice_of_measures_that_do_not_add_up(spark):
    import itertools
    import random

    from isotrend.operators.lattice import lattice_summary

    draw = random.Random(5)
    rows = [(draw.choice(["a1", "a2", "b1", None]), draw.randint(1, 12), draw.choice([None, float("nan"), *range(12)])) for _ in range(500)]
    rows = [(c, c and c[0], m, (m - 1) // 3, v if v is None else float(v)) for c, m, v in rows] + [("c1", "c", 1, 0, None)]
    df = spark.createDataFrame(rows, "county string, state string, month int, `the.season` int, v double")
    got = lattice_summary(df, ["county", "state"], ["month", "the.season"], "v", (0.5,))
    groups = {}
    for c, s, m, q, v in rows:
        for (x, y), (t, u) in itertools.product([(c, s), ("All", s), ("All", "All")], [(str(m), str(q)), ("All", str(q)), ("All", "All")]):
            groups.setdefault((x, y, t, u), []).append(v)
    assert got.count() == len(groups)
    for r in got.collect():
        all_rows = groups[tuple(r)[:4]]
        values = sorted(v for v in all_rows if v is not None and v == v)
        assert (r.rows, r.n) == (len(all_rows), len(values))
        if not values:
            assert r["mean"] is r.high is r.q50 is None
            continue
        middle = (len(values) - 1) / 2
        want = values[int(middle)] + (middle % 1) * (values[min(int(middle) + 1, len(values) - 1)] - values[int(middle)])
        assert r["mean"] == pytest.approx(sum(values) / len(values)) and (r.strict_mean is None) == (len(values) < len(all_rows))
        assert (r.high, r.high_rows, r.low, r.low_rows) == (values[-1], values.count(values[-1]), values[0], values.count(values[0]))
        assert r.q50 == pytest.approx(want)
