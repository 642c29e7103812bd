"""Baselines, anomalies and changes between periods.

Operators that compare years first reduce raw rows to one mean per entity and year. The
reduction combines map-side, so an entity with a third of all rows shuffles no more than
any other, and every later window holds at most one row per year.

``year`` is a column of year numbers or the name of a date column. From a date column the
year filters are ranges that reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrend.functions.calendar import (MONTHS, in_period, in_season, in_years, not_in_years, since_year,
                                           year_column)
from isotrend.functions.values import (CHANGE_BREAKS, CHANGE_LABELS, PERIOD_BREAKS, PERIOD_LABELS,
                                       bin_label)
from isotrend.operators.joins import area_attributes, attach, left_join
from isotrend.operators.reshape import mean_of, mean_where, rows_before, stack_tagged, value_at

Bins = tuple[Sequence[float], Sequence[str]]


def entity_year_mean(df: DataFrame, entity: str | Sequence[str], year: Column | str, value: str,
                     since: int | None = None) -> DataFrame:
    """Mean per entity and year, missing values skipped, optionally from a first year on."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    rows = df if since is None else df.filter(since_year(df, year, since))
    return rows.groupBy(*keys, year_column(df, year).alias("year")).agg(mean_of(value).alias("value"))


def entity_series(df: DataFrame, entity: str, name, when: str, value: str,
                  month: int | None = None, drop_year: int | None = None) -> DataFrame:
    """Yearly mean series of one entity, for one month or all, sorted by year."""
    rows = df.filter(F.col(entity) == name)
    if month is not None:
        rows = rows.filter(F.month(when) == month)
    if drop_year is not None:
        rows = rows.filter(not_in_years(rows, when, [drop_year]))
    return rows.groupBy(F.year(when).alias("year")).agg(mean_of(value).alias("value")).orderBy("year")


def season_slice(df: DataFrame, year: str, month: str, first: int, last: int, season: str) -> DataFrame:
    """Rows of one season between two years; an unknown season gives none."""
    return df.filter(in_years(df, year, first, last) & in_season(month, season))


def baseline_anomaly(df: DataFrame, entity: Sequence[str], year: Column | str, value: str,
                     base: tuple[int, int], month: Column | None = None) -> DataFrame:
    """Deviation of each value from its entity's mean over the base years.

    The base mean runs over all months of the entity; ``month`` then keeps matching rows.
    Without an entity the mean is one scalar, computed once.
    """
    past, mean = df.filter(in_years(df, year, *base)), mean_of(value).alias("baseline")
    if entity:
        rows = attach(df, past.groupBy(*entity).agg(mean), entity)
    else:
        rows = df.withColumn("baseline", past.agg(mean).scalar())
    if month is not None:
        rows = rows.filter(month)
    return rows.withColumn("anomaly", F.col(value) - F.col("baseline"))


def climatology(df: DataFrame, keys: Sequence[str], year: Column | str, value: str,
                base: tuple[int, int]) -> DataFrame:
    """Mean per month (and any other key) over the base years."""
    return df.filter(in_years(df, year, *base)).groupBy(*keys).agg(mean_of(value).alias("baseline"))


def climatology_anomaly(df: DataFrame, month: str, year: Column | str, value: str,
                        base: tuple[int, int], entity: Sequence[str] = ()) -> DataFrame:
    """Deviation of each value from the mean of its own month over the base years.

    ``month`` holds names or numbers of months; any other label has no climatology. So without
    an entity there are at most 25 rows whatever the data hold, and those are broadcast.
    """
    keys = [*entity, month]
    normal = climatology(df, keys, year, value, base)
    if entity:
        rows = attach(df, normal, keys)
    else:
        known = F.col(month).cast("string").isin(*MONTHS, *[str(i) for i in range(1, 13)])
        rows = left_join(df, F.broadcast(normal.filter(F.col(month).isNull() | known)), keys)
    return rows.withColumn("anomaly", F.col(value) - F.col("baseline"))


def period_change(df: DataFrame, entity: str | Sequence[str], when: str, value: str, baseline_year: int,
                  comparison_year: int, month: int | None = None,
                  bins: Bins = (PERIOD_BREAKS, PERIOD_LABELS)) -> DataFrame:
    """Mean of two years side by side, their difference and its ``[a, b)`` bin.

    One scan and one aggregation: the two years are conditional means, and the date filter
    reaches the scan as a range. Entities without a value in either year drop out.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    base, comparison = in_period(when, baseline_year, month), in_period(when, comparison_year, month)
    means = df.filter(base | comparison).groupBy(*keys).agg(
        mean_where(value, base).alias("baseline"), mean_where(value, comparison).alias("value"))
    diff = means.withColumn("diff", F.col("value") - F.col("baseline")).filter(F.col("diff").isNotNull())
    return diff.withColumn("category", bin_label("diff", *bins, right=False))


def change_frames(df: DataFrame, entity: str, year: Column | str, value: str, reference_year: int,
                  bins: Bins = (CHANGE_BREAKS, CHANGE_LABELS)) -> DataFrame:
    """Every entity and year against the entity's reference year, with its ``(a, b]`` bin.

    All frames in one job; write the result partitioned by year to serve one frame at a time.
    """
    yearly = entity_year_mean(df, entity, year, value)
    reference = value_at("value", F.col("year") == reference_year).over(Window.partitionBy(entity))
    diff = F.col("value") - F.col("reference")
    return yearly.withColumn("reference", reference).withColumns({
        "diff": diff,
        "category": bin_label(diff, *bins),
        "direction": F.when(diff >= 0, "hotter").when(diff < 0, "colder"),
    })


def change_vs_reference_year(df: DataFrame, entity: str, year: Column | str, value: str, at: int,
                             reference_year: int, bins: Bins = (CHANGE_BREAKS, CHANGE_LABELS)) -> DataFrame:
    """One frame of ``change_frames``: only the two years involved are aggregated."""
    rows = df.filter(in_years(df, year, at) | in_years(df, year, reference_year))
    return change_frames(rows, entity, year, value, reference_year, bins).filter(F.col("year") == at)


def year_over_year(df: DataFrame, entity: str, year: Column | str, value: str, gap: int = 1,
                   bins: Bins = (CHANGE_BREAKS, CHANGE_LABELS)) -> DataFrame:
    """Each year against the year exactly ``gap`` before it; a missing year gives NULL."""
    yearly = entity_year_mean(df, entity, year, value)
    previous = F.first("value").over(rows_before(entity, "year", gap))
    diff = F.col("value") - F.col("previous")
    return yearly.withColumn("previous", previous) \
                 .withColumns({"diff": diff, "category": bin_label(diff, *bins)})


def percent_change(df: DataFrame, keys: str | Sequence[str], year: Column | str, value: str,
                   first: int, last: int) -> DataFrame:
    """Mean of two years per group and the change in percent of the first one's size."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    at_first, at_last = in_years(df, year, first), in_years(df, year, last)
    means = df.filter(at_first | at_last).groupBy(*keys).agg(
        mean_where(value, at_first).alias("first_value"), mean_where(value, at_last).alias("last_value"))
    change = F.try_divide(F.col("last_value") - F.col("first_value"), F.abs("first_value")) * 100
    return means.withColumn("percent_change", change)


def year_snapshot(df: DataFrame, areas: DataFrame, area_key: str, entity: str, year: str, value: str,
                  at: int, bins: Bins | None = None) -> DataFrame:
    """All areas with their mean value in one year, NULL where an area has none.

    ``year`` is a column of year numbers or a date column; the filter comes before the mean, and
    from a date column it is a range that reaches the scan.
    """
    slice_ = df.filter(in_years(df, year, at)).groupBy(entity).agg(mean_of(value).alias(value))
    shown = area_attributes(areas, slice_, {area_key: entity})
    return shown if bins is None else shown.withColumn("category", bin_label(value, *bins))


def tag_and_stack(tables: Mapping[str, DataFrame], scale: Mapping[str, tuple[str, float]] | None = None,
                  tag: str = "source") -> DataFrame:
    """Stack tagged tables after bringing listed columns to a common unit.

    ``scale`` maps a table's tag to ``(column, factor)``: a difference in °C becomes °F by
    the factor 1.8 alone.
    """
    aligned = dict(tables)
    for label, (column, factor) in (scale or {}).items():
        aligned[label] = aligned[label].withColumn(column, F.col(column) * factor)
    return stack_tagged(aligned, tag)
