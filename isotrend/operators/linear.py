"""Multiple regression, analysis of variance, correlation and scaling.

A model is solved from its group's moment matrix: one row per model, whatever the number of
rows behind it. The k by k algebra runs in ``mapInPandas`` over those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotrend.functions.distributions import Z_975, f_upper_p, t_two_sided_p
from isotrend.functions.values import named, nan_to_null
from isotrend.operators.joins import attach
from isotrend.operators.moments import moment_matrix, quoted, result_keys

# A predictor is redundant when the share of its variance left by earlier ones is below this. Products of
# moments hold no more than about twelve digits, so shares near 1e-14 cannot be told from rounding.
ALIAS_TOLERANCE = 1e-10

TERM = T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()), T.StructField("std_error", T.DoubleType()),
    T.StructField("t", T.DoubleType()), T.StructField("std_estimate", T.DoubleType()),
    T.StructField("std_estimate_error", T.DoubleType()),
    T.StructField("ss", T.DoubleType()), T.StructField("vif", T.DoubleType())])
MODEL = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("df_model", T.IntegerType()),
    T.StructField("df_resid", T.LongType()), T.StructField("sse", T.DoubleType()),
    T.StructField("sst", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()), T.StructField("sigma", T.DoubleType()),
    T.StructField("f", T.DoubleType()), T.StructField("terms", T.ArrayType(TERM))])


def unpack_cross(cross: Sequence[float], k: int) -> np.ndarray:
    """Symmetric matrix from its stored upper triangle, or a stack of them."""
    cross = np.asarray(cross, float)
    full = np.zeros((*cross.shape[:-1], k, k))
    rows, columns = np.triu_indices(k)
    full[..., rows, columns] = full[..., columns, rows] = cross
    return full


def _independent(corr: np.ndarray) -> list[int]:
    """Positions of the predictors that are no combination of earlier ones."""
    left, kept = corr.copy(), []
    for j in range(len(corr)):
        if left[j, j] > ALIAS_TOLERANCE:
            kept.append(j)
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return kept


def _ratio(a: float, b: float) -> float | None:
    if b > 0:
        return float(a / b)
    return float(np.sign(a) * np.inf) if a else None


def scaled(cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the diagonal, and the products divided by them; for one matrix or a stack."""
    spread = np.sqrt(np.diagonal(cross, axis1=-2, axis2=-1))
    safe = np.where(spread > 0, spread, 1.0)
    return spread, cross / (safe[..., :, None] * safe[..., None, :])


def solve_model(n: int, means: np.ndarray, cross: np.ndarray, names: Sequence[str], inverse: np.ndarray | None = None) -> dict:
    """Least squares of variable 0 on the others, from centred products.

    The predictors are scaled to unit variance before solving, so a year near 2000 and a
    small anomaly are equally well conditioned. Redundant predictors get no estimate. ``inverse``
    is that of the predictors' correlations, where it is known and none is redundant.
    """
    spread, corr = scaled(cross)
    safe = np.where(spread > 0, spread, 1.0)
    kept = _independent(corr[1:, 1:]) if inverse is None else list(range(len(names)))
    at = [j + 1 for j in kept]
    sst = float(cross[0, 0])
    if inverse is None:
        inverse = np.linalg.inv(corr[np.ix_(at, at)]) if at else np.zeros((0, 0))
    beta = inverse @ corr[at, 0]
    sse = max(sst - float(beta @ corr[at, 0]) * sst, 0.0)
    sse = 0.0 if sse <= sst * 1e-15 else sse
    df_model, df_resid = len(at), int(n) - len(at) - 1
    mse = sse / df_resid if df_resid > 0 else None
    estimates = beta * spread[0] / safe[at]
    intercept = float(means[0] - estimates @ means[at])
    shift = means[at] / safe[at]
    terms = [dict(position=0, term="(Intercept)", estimate=intercept, std_error=None, t=None,
                  std_estimate=0.0, std_estimate_error=None, ss=None, vif=None)]
    if mse is not None:
        se = float(np.sqrt(mse * (1.0 / n + shift @ inverse @ shift)))
        # On standardised variables the intercept is zero, with the error of a mean.
        error = float(np.sqrt(mse / n) / (spread[0] / np.sqrt(n - 1))) if sst > 0 else None
        terms[0].update(std_error=se, t=_ratio(intercept, se), std_estimate_error=error)
    for j, name in enumerate(names):
        term = dict(position=j + 1, term=name, estimate=None, std_error=None, t=None,
                    std_estimate=None, std_estimate_error=None, ss=None, vif=None)
        if j in kept:
            i = kept.index(j)
            vif = float(inverse[i, i])
            term.update(estimate=float(estimates[i]), std_estimate=float(beta[i]) if sst > 0 else None,
                        vif=vif, ss=float(beta[i] ** 2 / vif * sst))
            if mse is not None:
                se = float(np.sqrt(mse * vif)) / float(safe[j + 1])
                term.update(std_error=se, t=_ratio(float(estimates[i]), se),
                            std_estimate_error=se * float(safe[j + 1] / spread[0]) if sst > 0 else None)
        terms.append(term)
    r2 = 1.0 - sse / sst if sst > 0 else None
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / df_resid if r2 is not None and df_resid > 0 else None
    f = _ratio((sst - sse) / df_model, mse) if df_model and mse is not None else None
    return dict(n=int(n), df_model=df_model, df_resid=df_resid, sse=sse, sst=sst, r2=r2,
                adj_r2=adjusted, sigma=None if mse is None else float(np.sqrt(mse)), f=f, terms=terms)


def solved(moments: DataFrame, keys: int, solve: Callable, body: T.StructType) -> DataFrame:
    """Solve the moments of a batch of groups at once.

    ``solve(n, means, cross)`` gets them stacked and yields (position in the batch, result fields).
    The first ``keys`` columns are keys; they are carried by position, so any name will do.
    """
    fields = moments.schema.fields
    inner = [T.StructField(f"__key{i}", f.dataType) for i, f in enumerate(fields[:keys])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, means, cross = (batch.iloc[:, keys + i] for i in range(3))
            some = np.flatnonzero(n.to_numpy() > 0)
            out = list(solve(n.to_numpy()[some], np.array(means.to_list(), float)[some],
                             np.array(cross.to_list(), float)[some])) if len(some) else []
            carried = batch.iloc[some[[at for at, _ in out]] if out else [], :keys].reset_index(drop=True)
            carried.columns = [f.name for f in inner]
            yield pd.concat([carried, pd.DataFrame([fields for _, fields in out], columns=body.names)], axis=1)

    unnamed = moments.toDF(*[f.name for f in inner], *[f.name for f in fields[keys:]])
    return unnamed.mapInPandas(run, T.StructType(inner + body.fields)).toDF(*[f.name for f in fields[:keys]], *body.names)


def fit_moments(moments: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One fitted model per row of moments; variable 0 is the response."""
    names = list(names)

    def solve(n: np.ndarray, means: np.ndarray, cross: np.ndarray) -> Iterator[tuple[int, dict]]:
        full = unpack_cross(cross, len(names) + 1)
        spread, corr = scaled(full)
        # Groups without redundant predictors are inverted together, the others one by one.
        whole = [len(_independent(c)) == len(names) for c in corr[:, 1:, 1:]]
        inverses = np.empty((len(n), len(names), len(names)))
        if any(whole):
            inverses[whole] = np.linalg.inv(corr[whole][:, 1:, 1:])
        for i in range(len(n)):
            yield i, solve_model(n[i], means[i], full[i], names, inverses[i] if whole[i] else None)

    return solved(moments, len(keys), solve, MODEL)


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on several predictors per group: one row per model.

    Rows with a missing value in any variable are left out. ``terms`` holds the coefficients;
    ``coefficients``, ``anova_table`` and ``vif_table`` spread them into rows.
    """
    return fit_moments(moment_matrix(df, [y, *xs], keys), xs, keys)


def coefficients(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per model and term, with the two-sided p-value; a redundant term is all NULL."""
    rows = models.select(*quoted(result_keys(keys)), "n", "df_resid", "r2", "adj_r2", "sigma", "f", "df_model",
                         F.inline("terms"))
    return rows.withColumn("p", t_two_sided_p("t", "df_resid"))


def model_tests(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per model: R², adjusted R², residual error, F and its p-value."""
    return models.select(*quoted(result_keys(keys)), "n", "df_model", "df_resid", "r2", "adj_r2", "sigma", "f",
                         f_upper_p("f", "df_model", "df_resid").alias("f_p"))


def anova_table(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of squares, degrees, mean square, F, share of reduced error and p per source.

    The sum of squares of a term is what it adds after all other terms.
    """
    null = F.lit(None).cast("double")

    def line(order: Column, source: Column, ss: Column, df: Column, f: Column, pre: Column) -> Column:
        return F.struct(order.cast("int").alias("position"), source.alias("source"), ss.alias("ss"),
                        df.cast("long").alias("df"), f.alias("f"), pre.alias("pre"))

    sse, sst, mse = F.col("sse"), F.col("sst"), F.try_divide(F.col("sse"), F.nullif("df_resid", F.lit(0)))
    model_ss = sst - sse
    head = line(F.lit(0), F.lit("Model"), model_ss, F.col("df_model"), F.col("f"), F.col("r2"))
    each = F.transform(
        F.filter("terms", lambda t: t["ss"].isNotNull()),
        lambda t: line(t["position"], t["term"], t["ss"], F.lit(1), t["t"] * t["t"],
                       F.try_divide(t["ss"], F.nullif(t["ss"] + sse, F.lit(0.0)))))
    last = F.size("terms")
    tail = [line(last, F.lit("Error"), sse, F.col("df_resid"), null, null),
            line(last + 1, F.lit("Total"), sst, F.col("n") - 1, null, null)]
    keys = quoted(result_keys(keys))
    rows = models.withColumn("__mse", mse).select(
        *keys, "df_resid", F.inline(F.concat(F.array(head), each, F.array(*tail))))
    return rows.withColumn("ms", F.try_divide("ss", F.nullif("df", F.lit(0)))) \
               .withColumn("p", f_upper_p("f", "df", "df_resid")) \
               .select(*keys, "position", "source", "ss", "df", "ms", "f", "pre", "p")


def vif_table(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Variance inflation factor of each predictor."""
    keys = quoted(result_keys(keys))
    return models.select(*keys, F.inline("terms")).filter(F.col("position") > 0) \
                 .select(*keys, "position", "term", "vif")


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every pair of columns: r, mean and deviation of both, 95 % interval, t and p.

    Each pair uses the rows where both are present; NaN counts as missing. One pass serves all pairs. Keys have
    the names of ``result_keys``.
    """
    keys, inner = list(keys), [f"__key{i}" for i in range(len(keys))]
    values = df.select(*[named(k).alias(i) for k, i in zip(keys, inner)],
                       *[nan_to_null(named(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])

    def pair(i: int, j: int) -> Column:
        a, b = F.col(f"v{i}"), F.col(f"v{j}")
        both = a.isNotNull() & b.isNotNull()
        return F.struct(F.lit(columns[i]).alias("first"), F.lit(columns[j]).alias("second"),
                        F.regr_count(a, b).alias("n"), F.corr(a, b).alias("r"),
                        F.avg(F.when(both, a)).alias("first_mean"), F.stddev_samp(F.when(both, a)).alias("first_sd"),
                        F.avg(F.when(both, b)).alias("second_mean"),
                        F.stddev_samp(F.when(both, b)).alias("second_sd")).alias(f"__pair{i}_{j}")

    pairs = list(combinations(range(len(columns)), 2))
    rows = values.groupBy(*inner).agg(*[pair(i, j) for i, j in pairs]).select(
        *[F.col(i).alias(name) for i, name in zip(inner, result_keys(keys))], F.inline(F.array(*[f"__pair{i}_{j}" for i, j in pairs])))
    half = F.lit(Z_975) / F.sqrt(F.when(F.col("n") > 3, F.col("n") - 3))
    whole = F.abs("r") >= 1
    fisher = F.when(~whole, F.atanh("r"))
    rest = F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))
    return rows.withColumn("df", F.col("n") - 2).withColumns({
        "ci_low": F.when(whole, F.col("r")).otherwise(F.tanh(fisher - half)),
        "ci_high": F.when(whole, F.col("r")).otherwise(F.tanh(fisher + half)),
        "t": F.when(whole, F.col("r") * float("inf")).otherwise(
            F.col("r") * F.sqrt(F.try_divide(F.when(F.col("df") > 0, F.col("df")), rest)))}) \
        .withColumn("p", t_two_sided_p("t", "df"))


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), suffix: str = "_z") -> DataFrame:
    """Add (x - mean) / sd with the n - 1 divisor; a constant column gives NULL, and so does a missing value or NaN.

    Without keys the statistics are one row, computed once as a scalar subquery.
    """
    values = [nan_to_null(named(c).cast("double")) for c in columns]
    slots = [f"__z{i}" for i in range(len(columns))]
    stats = [F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).alias(s) for v, s in zip(values, slots)]
    if keys:
        rows = attach(df, df.groupBy(*quoted(keys)).agg(*stats), list(keys))
    else:
        one = df.agg(F.struct(*stats).alias("all")).scalar()
        rows = df.withColumns({s: one[s] for s in slots})
    scaled = {f"{c}{suffix}": F.try_divide(v - F.col(s)["mean"], F.nullif(F.col(s)["sd"], F.lit(0.0)))
              for c, v, s in zip(columns, values, slots)}
    return rows.withColumns(scaled).drop(*slots)
