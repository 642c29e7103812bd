"""Models of many columns against those of few, against whole matrices, and where predictors nearly coincide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrend.operators import linear, pca, wide
from plans import final_plan

XS = ["a", "b.c", "d"]


def table(spark, seed=3, rows=400):
    draw = np.random.default_rng(seed)
    data = [(["g", "h", None][i % 3], float(1000 + x), float(y), float(z), float(5 + 2 * x - y + draw.normal()))
            for i, (x, y, z) in enumerate(draw.normal(size=(rows, 3)))]
    data += [("g", float("nan"), 1.0, 1.0, 1.0), ("g", 1.0, None, 1.0, 1.0), ("h", 1.0, 1.0, 1.0, float("nan"))]
    return spark.createDataFrame(data, "n string, a double, `b.c` double, d double, y double").repartition(7)


def close(got, want, tolerance=1e-8):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for name, value in a.asDict().items():
            if isinstance(value, float):
                assert value == pytest.approx(b[name], rel=tolerance, abs=1e-9), name
            else:
                assert value == b[name], name


def ordered(df, *by):
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in by]).collect()


@pytest.mark.parametrize("keys", [[], ["n"]])
@pytest.mark.parametrize("fit", [wide.ols_wide, wide.ols_qr])
def test_like_the_fit_of_few_columns(spark, keys, fit):
    df = table(spark)
    names = ["n_key"] if keys else []
    got = linear.coefficients(fit(df, wide.vector_of(["y", *XS]), XS, keys), keys).drop("std_estimate_error")
    want = linear.coefficients(linear.ols(df, "y", XS, keys), keys).drop("std_estimate_error")
    rows = [r for r in ordered(got, *names, "position")]
    close([r for r in rows if r.position], [r for r in ordered(want, *names, "position") if r.position], 1e-7)
    assert [r.estimate for r in rows] == pytest.approx([r.estimate for r in ordered(want, *names, "position")], rel=1e-7)


def test_components_like_those_of_few_columns(spark):
    df = table(spark).filter("y < 1e9")
    got = wide.pca_wide(df, wide.vector_of(["y", *XS]), 4, ["n"])
    want = pca.pca(df, ["y", *XS], ["n"])
    for a, b in zip(ordered(got, "n_key", "component"), ordered(want, "n_key", "component")):
        assert a.eigenvalue == pytest.approx(b.eigenvalue) and a.loadings == pytest.approx(b.loadings)


def wide_table(spark, columns, rows=900, parts=11):
    draw = np.random.default_rng(columns)
    x = draw.normal(size=(rows, columns)) + 50 * np.arange(columns)
    y = x @ np.linspace(-1, 1, columns) + draw.normal(size=rows)
    data = np.column_stack([y, x])
    return data, spark.createDataFrame([(row.tolist(),) for row in data], "v array<double>").repartition(parts)


@pytest.mark.parametrize("fit", [wide.ols_wide, wide.ols_qr])
def test_hundreds_of_columns(spark, fit):
    data, df = wide_table(spark, 230)
    names = [f"x{i}" for i in range(230)]
    model = fit(df, F.col("v"), names).collect()[0]
    design = np.column_stack([np.ones(len(data)), data[:, 1:]])
    beta, sse, _, _ = np.linalg.lstsq(design, data[:, 0], rcond=None)
    assert [t.estimate for t in model.terms[1:]] == pytest.approx(beta[1:].tolist(), rel=1e-6, abs=1e-8)
    assert model.sse == pytest.approx(float(sse[0]), rel=1e-7) and model.df_resid == 900 - 231


def test_blocks_merge_to_the_whole_matrix(spark):
    data, df = wide_table(spark, 150)
    row = wide.wide_moments(df, F.col("v"), 151).collect()[0]
    full = linear.unpack_cross(row.cross, 151)
    away = data - data.mean(axis=0)
    assert row.n == 900 and np.allclose(row.means, data.mean(axis=0))
    assert np.allclose(full, away.T @ away, rtol=1e-9, atol=1e-7)


def test_plan_does_not_grow_with_the_columns(spark):
    plans = [final_plan(wide.pca_wide(wide_table(spark, k, 60, 3)[1], F.col("v"), k + 1)) for k in (20, 250)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) < 60


def test_rows_do_not_shuffle(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    vector = F.array("l_extendedprice", "l_quantity", "l_tax")
    plan = final_plan(wide.ols_qr(lines, vector, ["q", "t"], ["l_returnflag"]))
    assert plan.count("FileScan") == 1 and plan.rindex("MapInArrow") > plan.rindex("Exchange")


def test_a_share_of_1e_12_of_the_variance(spark):
    """Exact solution by fractions; products of moments cannot tell the two predictors apart."""
    draw = np.random.default_rng(8)
    x, d = draw.integers(-50, 50, 500) * 1.0, draw.integers(-3, 4, 500) * 2.0 ** -16
    y = 3 + 2 * x - 4 * (x + d)
    df = spark.createDataFrame([(float(c), float(a), float(a + b)) for a, b, c in zip(x, d, y)], "y double, a double, b double").repartition(5)
    near = wide.ols_qr(df, wide.vector_of(["y", "a", "b"]), ["a", "b"]).collect()[0]
    share = float(np.var(d) / np.var(x + d))
    assert share < 1e-11
    assert [t.estimate for t in near.terms] == pytest.approx([3, 2, -4], rel=1e-5)
    assert linear.ols(df, "y", ["a", "b"]).collect()[0].terms[2].estimate is None


def test_redundant_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, 5.0), (2.0, 2.0, 4.0, 1.0), (2.0, 3.0, 6.0, 2.0), (5.0, 4.0, 8.0, 0.0)], "y double, a double, b double, c double")
    got = wide.ols_qr(df, wide.vector_of(["y", "a", "b", "c"]), ["a", "b", "c"]).collect()[0]
    want = linear.ols(df, "y", ["a", "b", "c"]).collect()[0]
    assert [t.estimate for t in got.terms] == [pytest.approx(t.estimate) if t.estimate is not None else None for t in want.terms]
    assert got.terms[2].estimate is None and got.df_resid == want.df_resid == 1
    two = wide.ols_qr(df.limit(2), wide.vector_of(["y", "a", "c"]), ["a", "c"]).collect()[0]
    assert two.n == 2 and two.df_resid == 0 and two.terms[2].estimate is None and two.terms[1].std_error is None


def test_many_groups_pass_through(spark):
    df = spark.range(3000).selectExpr("id % 500 g", "array(2D * id, cast(id as double), cast(id * id % 7 as double)) v").repartition(4)
    rows = wide.ols_wide(df, F.col("v"), ["x", "z"], ["g"]).collect()
    assert len(rows) == 500 and all(r.n == 6 and r.terms[1].estimate == pytest.approx(2) for r in rows)


def test_nothing(spark):
    none = table(spark).filter("false")
    for found in (wide.ols_qr(none, wide.vector_of(["y", *XS]), XS), wide.ols_wide(none, wide.vector_of(["y", *XS]), XS, ["n"]),
                  wide.pca_wide(none, wide.vector_of(XS), 3)):
        assert found.collect() == []
