"""Straight-line trends for one group or millions, with their tests and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.functions.calendar import ALL_MONTHS, MONTHS, level_index, not_in_years, year_column
from isotrend.functions.distributions import t_quantile_975, t_two_sided_p
from isotrend.functions.values import as_col, named, recode
from isotrend.operators.joins import area_attributes, attach
from isotrend.operators.moments import add_merged_total, pair_columns, pair_moments
from isotrend.operators.order_stats import exact_quantiles
from isotrend.operators.reshape import present
from isotrend.session import settle

SIGNIFICANT = 0.05
# Category labels of the significance table, and the order they sort in.
CATEGORY_NAMES = {"positive": "Positive Slope Counties", "not_significant": "Not Significant",
                  "negative": "Negative Slope Counties"}


# The fitted line and its tests, each line using the names before it. A perfect fit leaves
# dust of the size of the machine precision, which counts as zero.
FIT = """sxy / CASE WHEN sxx > 0 THEN sxx END AS slope
mean_y - slope * mean_x AS intercept
n - 2 AS dof
CASE WHEN syy - slope * sxy <= syy * 1e-15D THEN 0D ELSE syy - slope * sxy END AS sse
slope * sxy / nullif(syy, 0D) AS r2
sqrt(sse / CASE WHEN dof > 0 THEN dof END) AS sigma
sigma / sqrt(nullif(sxx, 0D)) AS slope_se
sigma * sqrt(1D / nullif(n, 0) + mean_x * mean_x / nullif(sxx, 0D)) AS intercept_se
1 - (1 - r2) * (n - 1) / CASE WHEN dof > 0 THEN dof END AS adj_r2
CASE WHEN slope_se = 0 AND slope <> 0 THEN sign(slope) * double('inf') ELSE slope / nullif(slope_se, 0D) END AS slope_t
CASE WHEN intercept_se = 0 AND intercept <> 0 THEN sign(intercept) * double('inf')
 ELSE intercept / nullif(intercept_se, 0D) END AS intercept_t
slope_t * slope_t AS f"""


def fit_columns(moments: DataFrame) -> DataFrame:
    """Add the fitted line and its tests to rows of pair moments.

    A constant x has no line: all its figures are NULL. A perfect fit has p = 0, and two
    points have a line but no p-value, since no degree of freedom is left.
    """
    lines = FIT.replace("\n ELSE", " ELSE").split("\n")
    return moments.selectExpr("*", *lines).withColumn("slope_p", t_two_sided_p("slope_t", "dof"))


def complete_pairs(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """``__x, __y`` of the rows that have both; NaN counts as missing."""
    rows = df.select(*keys, *[present(named(c).cast("double")).alias(a) for c, a in ((x, "__x"), (y, "__y"))])
    return rows.filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())


def trend_fit(df: DataFrame, x: Column | str, y: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Simple least squares of y on x per group: coefficients, errors, tests, R² and F."""
    fitted = fit_columns(pair_moments(df, x, y, keys))
    return fitted.withColumn("intercept_p", t_two_sided_p("intercept_t", "dof"))


def standardised_slope(fit: DataFrame) -> DataFrame:
    """Slopes after scaling y, or both x and y, to unit deviation, and their standard errors: ratios of one fit's moments."""
    sd_x, sd_y = (F.sqrt(F.try_divide(F.col(s), F.nullif(F.col("n") - 1, F.lit(0)))) for s in ("sxx", "syy"))
    sd_y = F.nullif(sd_y, F.lit(0.0))
    return fit.withColumns({f"{c}_scaled{end}": F.try_divide(F.col(c) * factor, sd_y)
                            for c in ("slope", "slope_se") for end, factor in (("_y", F.lit(1.0)), ("", sd_x))})


def residual_summary(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles and maximum of the residuals of each group's line."""
    # Every later use of the lines reads them; none fits them again.
    line = settle(fit_columns(pair_moments(df, x, y, keys)).select(*keys, "slope", "intercept"))
    pairs = complete_pairs(df, x, y, keys)
    if keys:
        rows = attach(pairs, line, list(keys))
    else:
        one = line.select(F.struct("slope", "intercept").alias("line")).scalar()
        rows = pairs.withColumn("line", one).select("__x", "__y", "line.slope", "line.intercept")
    residual = F.col("__y") - F.col("intercept") - F.col("slope") * F.col("__x")
    return exact_quantiles(rows.select(*keys, residual.alias("residual")), "residual",
                           (0.0, 0.25, 0.5, 0.75, 1.0), keys,
                           ("min", "q1", "median", "q3", "max"))


def trend_test(df: DataFrame, entity: str | Sequence[str], month: Column | str, year: Column | str,
               value: str, exclude_years: Sequence[int] = ()) -> DataFrame:
    """Trend of value on year for every entity, for each month and for all months together.

    One scan and one large aggregation, to entity and month. The all-months model is merged
    from its at most twelve parts, so rows are neither read nor expanded twice. Groups
    without two values are not models and give no row. ``year`` is a column of year numbers
    or the name of a date column, from which excluded years are ranges the scan can skip.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    kept = df.filter(not_in_years(df, year, exclude_years)) if exclude_years else df
    rows = kept.select(*keys, as_col(month).cast("string").alias("month"),
                       year_column(df, year).alias("__year"), F.col(value).alias("__value"))
    monthly = pair_moments(rows, "__year", "__value", [*keys, "month"])
    models = add_merged_total(monthly, keys, "month", ALL_MONTHS)
    return fit_columns(models.filter(F.col("month").isNotNull() & (F.col("n") > 1)))


def _summary(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    fitted = F.col("slope").isNotNull()
    significant = F.coalesce(F.col("slope_p") < SIGNIFICANT, F.lit(False))
    return tests.groupBy(*keys).agg(
        F.count_if(fitted & significant).alias("significant"),
        F.count_if(fitted & significant & (F.col("slope") > 0)).alias("positive"),
        F.count_if(fitted & significant & (F.col("slope") < 0)).alias("negative"),
        F.count_if(fitted & ~significant).alias("not_significant"))


def significance_by_month(tests: DataFrame) -> DataFrame:
    """Per month, how many entities rise, fall or show no significant trend.

    An undefined p-value (two points) counts as not significant; a constant year counts nowhere.
    """
    return _summary(tests, ["month"])


def significance_by_entity(tests: DataFrame, entity: str | Sequence[str]) -> DataFrame:
    """Per entity, the same counts over its months and the all-months model, and their balance."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    counts = _summary(tests, keys)
    return counts.withColumn("slope_diff", F.col("positive") - F.col("negative"))


def significance_map(areas: DataFrame, tests: DataFrame, area_key: str, entity: str) -> DataFrame:
    """Every area with its significance counts, NULL where no model was fitted."""
    return area_attributes(areas, significance_by_entity(tests, entity), {area_key: entity})


def significance_long(by_month: DataFrame, names: Mapping[str, str] = CATEGORY_NAMES) -> DataFrame:
    """One row per month and category with display names and sort ordinals.

    The all-months label is not a month, so its month becomes NULL.
    """
    long = by_month.unpivot(["month", "significant"], ["negative", "not_significant", "positive"],
                            "category", "count")
    ordinal = level_index("month", MONTHS)
    return long.select(F.when(ordinal.isNotNull(), F.col("month")).alias("month"),
                       ordinal.alias("month_ordinal"), F.col("significant"),
                       recode("category", names).alias("category"),
                       level_index("category", list(names)).alias("category_ordinal"), "count")


def trend_delta(fit: DataFrame, first: int, last: int, places: int = 3) -> DataFrame:
    """Fitted change between two years and the same per year, each rounded.

    The yearly figure divides the rounded change, so it is rounded twice.
    """
    at_first = F.col("intercept") + F.col("slope") * first
    at_last = F.col("intercept") + F.col("slope") * last
    return fit.withColumns({"predicted_first": at_first, "predicted_last": at_last}) \
              .withColumn("delta", F.bround(F.col("predicted_last") - F.col("predicted_first"), places)) \
              .withColumn("per_year", F.bround(F.col("delta") / (last - first), places))


def trend_band(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), points: int = 80) -> DataFrame:
    """The fitted line with its 95 % confidence band on an even grid over each group's x range."""
    moments = complete_pairs(df, x, y, keys)
    ranged = moments.groupBy(*keys).agg(*pair_columns("__x", "__y"), F.min("__x").alias("low"),
                                        F.max("__x").alias("high"))
    fit = fit_columns(ranged).withColumn("t975", t_quantile_975("dof"))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    grid = fit.select("*", step).withColumn(
        "x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1))
    away = F.col("x") - F.col("mean_x")
    se = F.col("sigma") * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(away * away, F.col("sxx")))
    fitted = grid.withColumns({"fitted": F.col("intercept") + F.col("slope") * F.col("x"), "se": se})
    return fitted.withColumns({"lower": F.col("fitted") - F.col("t975") * F.col("se"),
                               "upper": F.col("fitted") + F.col("t975") * F.col("se")}) \
                 .select(*keys, "point", "x", "fitted", "se", "lower", "upper")
