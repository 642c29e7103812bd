"""Moments per entity, year and month, kept between runs: new months are added, and models follow without the raw rows.

A store is a folder with one part per batch. A part holds count, mean and centred squares of a value, so parts of
any cut of the rows merge exactly, and an entity with a third of all rows has no more lines than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isotrend.functions.calendar import ALL_MONTHS, month_name
from isotrend.functions.values import PERIOD_BREAKS, PERIOD_LABELS, bin_label, named
from isotrend.operators.change import Bins
from isotrend.operators.moments import PAIR, add_merged_total
from isotrend.operators.reshape import present
from isotrend.operators.trend import fit_columns

MOMENTS = ("n", "mean", "squares")


def month_moments(df: DataFrame, keys: Sequence[str], when: str, value: str) -> DataFrame:
    """Count, mean and centred squares of the values that are there, per key, year and month of a date column."""
    v = present(named(value).cast("double"))
    return df.groupBy(*[named(k) for k in keys], F.year(when).alias("year"), F.month(when).alias("month")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("squares"))


def add_batch(df: DataFrame, path: str, batch: str, keys: Sequence[str], when: str, value: str) -> None:
    """Add the moments of a batch of rows to the store at ``path``.

    A batch has a folder of its own, named by its id and replaced as a whole, so one that is written again, after a
    failure or by mistake, counts once. What it costs follows from the batch, not from the store.
    """
    if "/" in batch or "=" in batch:
        raise ValueError(f"a batch id without / and = is expected, not {batch!r}")
    parts = month_moments(df, keys, when, value)
    parts.hint("rebalance", *[named(k) for k in keys]).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _together(parts: Column) -> Column:
    """Moments of the parts of one month: a month comes in few batches."""
    def add(state: Column, part: Column) -> Column:
        n, away = state["n"] + part["n"], part["mean"] - state["mean"]
        return F.struct(n.alias("n"), (state["mean"] + away * part["n"] / n).alias("mean"),
                        (state["squares"] + part["squares"] + away * away * state["n"] * part["n"] / n).alias("squares"))

    there = F.filter(F.sort_array(parts), lambda p: p["n"] > 0)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(F.transform(there, lambda p: F.struct(*[p[c].alias(c) for c in MOMENTS])), zero, add)


def read_store(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """One row per key, year and month with the moments of all batches together; a month without values has no row."""
    rows = spark.read.parquet(path)
    whole = rows.groupBy(*[named(k) for k in keys], "year", "month").agg(
        _together(F.collect_list(F.struct(F.col("batch").cast("string").alias("batch"), *MOMENTS))).alias("all"))
    return whole.select(*[named(k) for k in keys], "year", "month", *[F.col(f"all.{c}").alias(c) for c in MOMENTS]).filter("n > 0")


def merged_pairs(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair moments (``PAIR``) of each group from those of its parts, which are few: the between parts and the within."""
    whole = Window.partitionBy(*keys)
    n = F.sum("n").over(whole)
    centred = parts.withColumns({"__mx": F.sum(F.col("n") * F.col("mean_x")).over(whole) / n,
                                 "__my": F.sum(F.col("n") * F.col("mean_y")).over(whole) / n})
    dx, dy = F.col("mean_x") - F.col("__mx"), F.col("mean_y") - F.col("__my")
    return centred.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("__mx").alias("mean_x"), F.first("__my").alias("mean_y"),
        F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"), F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy")).select(*keys, *PAIR)


def trend_from_moments(moments: DataFrame, keys: Sequence[str], exclude_years: Sequence[int] = ()) -> DataFrame:
    """``trend.trend_test`` from stored moments: trends on the year for each month and for all months together."""
    keys = list(keys)
    rows = moments.filter(~F.col("year").isin(*exclude_years)) if exclude_years else moments
    zero = F.lit(0.0)
    parts = rows.select(*keys, month_name("month").alias("month"), "n", F.col("year").cast("double").alias("mean_x"),
                        F.col("mean").alias("mean_y"), zero.alias("sxx"), F.col("squares").alias("syy"), zero.alias("sxy"))
    models = add_merged_total(merged_pairs(parts, [*keys, "month"]), keys, "month", ALL_MONTHS)
    return fit_columns(models.filter(F.col("month").isNotNull() & (F.col("n") > 1)))


def period_change_from_moments(moments: DataFrame, keys: Sequence[str], baseline_year: int, comparison_year: int,
                               month: int | None = None, bins: Bins = (PERIOD_BREAKS, PERIOD_LABELS)) -> DataFrame:
    """``change.period_change`` from stored moments; where these are bucketed by key, without an exchange."""
    rows = moments.filter(F.col("year").isin(baseline_year, comparison_year))
    rows = rows if month is None else rows.filter(F.col("month") == month)

    def mean(year: int) -> Column:
        here = F.col("year") == year
        return F.try_divide(F.sum(F.when(here, F.col("n") * F.col("mean"))), F.sum(F.when(here, F.col("n"))))

    means = rows.groupBy(*keys).agg(mean(baseline_year).alias("baseline"), mean(comparison_year).alias("value"))
    diff = means.withColumn("diff", F.col("value") - F.col("baseline")).filter(F.col("diff").isNotNull())
    return diff.withColumn("category", bin_label("diff", *bins, right=False))


def yearly_from_moments(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``change.entity_year_mean`` from stored moments."""
    return moments.groupBy(*keys, "year").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("value"))
