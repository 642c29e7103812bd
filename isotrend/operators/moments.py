"""Centred moments: the one scan behind every model.

All regressions, correlations and components are functions of counts, means and centred
sums of products. Those are declarative aggregates that combine map-side, so the rows of a
group never meet in one task, and the models are then solved on one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrend.functions.values import named, nan_to_null

PAIR = ("n", "mean_x", "mean_y", "sxx", "syy", "sxy")


# Columns that results of models have; a key of the same name gets an ending.
RESULT_NAMES = frozenset("""n means cross df_model df_resid sse sst r2 adj_r2 sigma f terms position term estimate std_error t
 std_estimate std_estimate_error ss vif p f_p component eigenvalue sdev share cumulative loadings sds percent
 cumulative_percent variable loading coordinate cos2 source df ms pre first second r first_mean first_sd second_mean
 second_sd ci_low ci_high""".split())


def result_keys(keys: Sequence[str]) -> list[str]:
    """Names of the keys in results: ``n`` and the like become ``n_key``, all others stay."""
    return [f"{k}_key" if k in RESULT_NAMES else k for k in keys]


def quoted(keys: Sequence[str]) -> list[Column]:
    return [named(k) for k in keys]


def pair_columns(x: Column | str, y: Column | str) -> list[Column]:
    """Moments of the complete (x, y) pairs of a group; centred, never raw sums of squares."""
    x, y = (nan_to_null((F.col(c) if isinstance(c, str) else c).cast("double")) for c in (x, y))
    return [F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mean_x"),
            F.regr_avgy(y, x).alias("mean_y"), F.regr_sxx(y, x).alias("sxx"),
            F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")]


def pair_moments(df: DataFrame, x: Column | str, y: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """One row of pair moments per group."""
    return df.groupBy(*keys).agg(*pair_columns(x, y))


def add_merged_total(parts: DataFrame, keys: Sequence[str], part: str, label: str) -> DataFrame:
    """Beside the moments of each part of a group, those of the whole group, merged exactly.

    Deviations between the part means are added to the deviations within the parts. The
    parts are few per group (months), so the total costs a step over a handful of rows in
    place of a second pass over the data, and the plan keeps one scan and no self-join.
    """
    whole = Window.partitionBy(*keys)
    n = F.sum("n").over(whole)
    centred = parts.withColumns({
        "__n": n,
        "__mx": F.try_divide(F.sum(F.col("n") * F.col("mean_x")).over(whole), n),
        "__my": F.try_divide(F.sum(F.col("n") * F.col("mean_y")).over(whole), n),
        "__first": F.row_number().over(whole.orderBy(part)) == 1,
    }).withColumns({"__dx": F.col("mean_x") - F.col("__mx"), "__dy": F.col("mean_y") - F.col("__my")})

    def total(within: str, a: str, b: str) -> Column:
        between = F.coalesce(F.col("n") * F.col(a) * F.col(b), F.lit(0.0))
        return F.sum(F.coalesce(F.col(within), F.lit(0.0)) + between).over(whole)

    summed = centred.withColumns({"__sxx": total("sxx", "__dx", "__dx"), "__syy": total("syy", "__dy", "__dy"),
                                  "__sxy": total("sxy", "__dx", "__dy")})
    own = F.struct(part, *PAIR)
    merged = F.struct(F.lit(label).alias(part), *[F.col(c).alias(name) for c, name in
                                                  zip(("__n", "__mx", "__my", "__sxx", "__syy", "__sxy"), PAIR)])
    rows = F.when(F.col("__first"), F.array(own, merged)).otherwise(F.array(own))
    return summed.select(*keys, F.explode(rows).alias("row")).select(*keys, "row.*")


def moment_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``n``, ``means`` and the upper triangle ``cross`` of centred products.

    Keys have the names of ``result_keys``. Rows with a missing value in any listed column are left out, as a model fit does.
    """
    keys = list(keys)
    values = df.select(*[named(k).alias(f"__key{i}") for i, k in enumerate(keys)],
                       *[nan_to_null(named(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        values = values.filter(F.col(f"v{i}").isNotNull())
    inner = [f"__key{i}" for i in range(len(keys))]
    k = range(len(columns))
    pairs = list(combinations_with_replacement(k, 2))
    products = [(F.var_pop(f"v{i}") if i == j else F.covar_pop(f"v{i}", f"v{j}")).alias(f"c{i}_{j}")
                for i, j in pairs]
    sums = values.groupBy(*inner).agg(F.count(F.lit(1)).alias("n"),
                                     *[F.avg(f"v{i}").alias(f"m{i}") for i in k], *products)
    return sums.select(*[F.col(i).alias(name) for i, name in zip(inner, result_keys(keys))], "n",
                       F.array(*[f"m{i}" for i in k]).alias("means"),
                       F.array(*[F.col(f"c{i}_{j}") * F.col("n") for i, j in pairs]).alias("cross"))
