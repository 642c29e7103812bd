"""Principal components of standardised columns, their scores, and regression on them.

Components come from the correlation matrix, itself one aggregation; no pass over z-scores
is needed, and a regression on the scores is solved from the same moments.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotrend.functions.values import named
from isotrend.operators.joins import left_join
from isotrend.operators.linear import fit_moments, scaled, solved, unpack_cross
from isotrend.operators.moments import moment_matrix, quoted, result_keys
from isotrend.operators.reshape import present

COMPONENT = T.StructType([
    T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("eigenvalue", T.DoubleType()), T.StructField("sdev", T.DoubleType()),
    T.StructField("share", T.DoubleType()), T.StructField("cumulative", T.DoubleType()),
    T.StructField("loadings", T.ArrayType(T.DoubleType())),
    T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("sds", T.ArrayType(T.DoubleType()))])


def components(n: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and loadings by column, of standardised variables; for a stack of groups.

    Variances divide by n while the scaling divides by n - 1, hence the factor (n - 1) / n.
    Each component is turned so that its first loading is not negative.
    """
    n = np.asarray(n, float)[..., None]
    values, vectors = np.linalg.eigh(scaled(cross)[1])
    values, vectors = values[..., ::-1], vectors[..., ::-1]
    vectors = vectors * np.where(vectors[..., :1, :] < 0, -1.0, 1.0)
    return np.clip(values, 0.0, None) * (n - 1) / n, vectors


def _usable(n: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Places of the groups that have a standardised form: two rows at least, and no constant column."""
    return np.flatnonzero((n > 1) & (np.diagonal(cross, axis1=1, axis2=2) > 0).all(axis=1))


def pca(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group and component: eigenvalue, deviation, variance share and loadings.

    Groups with a constant column have no standardised form and give no row.
    """
    return components_of(moment_matrix(df, columns, keys), len(columns), len(keys))


def components_of(moments: DataFrame, k: int, keys: int) -> DataFrame:
    """The components behind rows of moments, of which the first ``keys`` columns are keys."""
    def solve(n: np.ndarray, means: np.ndarray, cross: np.ndarray) -> Iterator[tuple[int, dict]]:
        full = unpack_cross(cross, k)
        at = _usable(n, full)
        values, vectors = components(n[at], full[at])
        shares = values / values.sum(axis=1, keepdims=True)
        for g, i in enumerate(at):
            scale = {"means": means[i].tolist(), "sds": np.sqrt(np.diag(full[i]) / (n[i] - 1)).tolist()}
            for j in range(k):
                yield i, {"component": j + 1, "n": n[i], "eigenvalue": values[g, j], "sdev": float(np.sqrt(values[g, j])),
                          "share": shares[g, j], "cumulative": float(shares[g, :j + 1].sum()),
                          "loadings": vectors[g, :, j].tolist(), **scale}

    return solved(moments, keys, solve, COMPONENT)


def scree(fit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Eigenvalue, percent of variance and cumulative percent per component."""
    return fit.select(*quoted(result_keys(keys)), "component", "eigenvalue", (F.col("share") * 100).alias("percent"),
                      (F.col("cumulative") * 100).alias("cumulative_percent"))


def variable_map(fit: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Loading, coordinate (loading × deviation) and cos² of every variable on every component."""
    names, keys = F.array(*[F.lit(c) for c in columns]), quoted(result_keys(keys))
    rows = fit.select(*keys, "component", "sdev", F.posexplode("loadings").alias("at", "loading"))
    coordinate = F.col("loading") * F.col("sdev")
    return rows.select(*keys, "component", F.get(names, F.col("at")).alias("variable"), "loading",
                       coordinate.alias("coordinate"), (coordinate * coordinate).alias("cos2"))


def cos2_total(variables: DataFrame, axes: Sequence[int] = (1, 2), keys: Sequence[str] = ()) -> DataFrame:
    """How well the chosen axes together represent each variable."""
    return variables.filter(F.col("component").isin(*axes)) \
                    .groupBy(*quoted(result_keys(keys)), "variable").agg(F.sum("cos2").alias("cos2"))


def scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``score_1`` … ``score_k`` to every complete row: its z-scores times the loadings.

    Means, deviations and loadings are one small row per group.
    """
    k, complete = len(columns), df
    for c in columns:
        complete = complete.filter(present(c).isNotNull())
    by_axis = F.sort_array(F.collect_list(F.struct("component", "loadings")))
    names = result_keys(keys)
    fit = pca(df, columns, keys).groupBy(*quoted(names)).agg(
        F.struct(by_axis.alias("axes"), F.first("means").alias("means"), F.first("sds").alias("sds")).alias("__fit"))
    rows = left_join(complete, fit, dict(zip(keys, names))) if keys else complete.withColumn("__fit", fit.scalar())
    z = [F.try_divide(named(c) - F.col("__fit.means")[i], F.nullif(F.col("__fit.sds")[i], F.lit(0.0)))
         for i, c in enumerate(columns)]
    rows = rows.withColumns({f"__z{i}": v for i, v in enumerate(z)})
    dots = {f"score_{j + 1}": sum((F.col(f"__z{i}") * F.col("__fit.axes")[j]["loadings"][i] for i in range(1, k)),
                                  F.col("__z0") * F.col("__fit.axes")[j]["loadings"][0]) for j in range(k)}
    return rows.withColumns(dots).drop("__fit", *[f"__z{i}" for i in range(k)])


def pcr(df: DataFrame, y: str, columns: Sequence[str], n_components: int | None = None,
        keys: Sequence[str] = ()) -> DataFrame:
    """Regression of y on the first component scores: one model per group.

    The products of y with the scores are the loadings applied to its products with the
    columns, so the scores themselves are never computed.
    """
    keys, k = list(keys), len(columns)
    used = k if n_components is None else n_components
    moments = moment_matrix(df, [y, *columns], keys)

    def rotate(n: np.ndarray, means: np.ndarray, cross: np.ndarray) -> Iterator[tuple[int, dict]]:
        full = unpack_cross(cross, k + 1)
        at = _usable(n, full[:, 1:, 1:])
        values, vectors = components(n[at], full[at][:, 1:, 1:])
        for g, i in enumerate(at):
            sd = np.sqrt(np.diag(full[i])[1:] / (n[i] - 1))
            turned = np.diag(np.concatenate([[full[i, 0, 0]], values[g, :used] * n[i]]))
            turned[0, 1:] = turned[1:, 0] = (vectors[g].T @ (full[i, 0, 1:] / sd))[:used]
            yield i, {"n": n[i], "means": [means[i, 0]] + [0.0] * used, "cross": turned[np.triu_indices(used + 1)].tolist()}

    turned = solved(moments, len(keys), rotate, T.StructType(moments.schema.fields[len(keys):]))
    return fit_moments(turned, [f"score_{i + 1}" for i in range(used)], keys)
