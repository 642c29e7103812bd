"""Month, season and year helpers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names in order and the months of each season.
MONTHS = ("January", "February", "March", "April", "May", "June",
          "July", "August", "September", "October", "November", "December")
SEASONS = {
    "Winter": ("December", "January", "February"),
    "Spring": ("March", "April", "May"),
    "Summer": ("June", "July", "August"),
    "Fall": ("September", "October", "November"),
    "All Seasons": MONTHS,
    "World": MONTHS,
}
ALL_MONTHS = "All Months"


def level_index(value: Column | str, levels: tuple[str, ...] | list[str]) -> Column:
    """1-based position of a category in its level list, NULL when it is not a level."""
    value = F.col(value) if isinstance(value, str) else value
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), value)
    return F.when(position > 0, position.cast("int"))


def month_number(name: Column | str) -> Column:
    """Month name to 1..12; any other text gives NULL."""
    return level_index(name, MONTHS)


def month_name(number: Column | str) -> Column:
    """1..12 to the month name; anything else gives NULL."""
    number = F.col(number) if isinstance(number, str) else number
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), number.cast("int") - 1)


def in_season(month: Column | str, season: str) -> Column:
    """Whether a month name belongs to ``season``; an unknown season matches no row."""
    month = F.col(month) if isinstance(month, str) else month
    return month.isin(*SEASONS[season]) if season in SEASONS else F.lit(False)


def season_of(month: Column | str) -> Column:
    """Quarter-of-year season label of a month name."""
    month = F.col(month) if isinstance(month, str) else month
    label = F.lit(None).cast("string")
    for season in ("Winter", "Spring", "Summer", "Fall"):
        label = F.when(month.isin(*SEASONS[season]), season).otherwise(label)
    return label


def _day(year: int, month: int) -> Column:
    """First day of a month; beyond the years a Python date can hold, a constant the planner folds."""
    return F.lit(date(year, month, 1)) if year <= date.max.year else F.make_date(F.lit(year), F.lit(month), F.lit(1))


def year_between(when: Column | str, first: int, last: int) -> Column:
    """Year range as a plain range on the date column, which reaches the Parquet scan.

    ``year(d) BETWEEN a AND b`` hides the column inside a function and is not pushed.
    """
    when = F.col(when) if isinstance(when, str) else when
    return (when >= _day(first, 1)) & (when < _day(last + 1, 1))


def in_period(when: Column | str, year: int, month: int | None = None) -> Column:
    """One year, or one month of it, as a pushable range on the date column."""
    if month is None:
        return year_between(when, year, year)
    when = F.col(when) if isinstance(when, str) else when
    after = _day(year + month // 12, month % 12 + 1)
    return (when >= _day(year, month)) & (when < after)


def _is_date(df: DataFrame, name: Column | str) -> bool:
    return isinstance(name, str) and isinstance(df.schema[name].dataType,
                                                (T.DateType, T.TimestampType, T.TimestampNTZType))


def year_column(df: DataFrame, year: Column | str) -> Column:
    """The year as a number, from a year column or from a date column."""
    if _is_date(df, year):
        return F.year(year)
    return (F.col(year) if isinstance(year, str) else year).cast("int")


def in_years(df: DataFrame, year: Column | str, first: int, last: int | None = None) -> Column:
    """Whether a row falls between two years; on a date column this is a pushable range."""
    last = first if last is None else last
    if _is_date(df, year):
        return year_between(year, first, last)
    return year_column(df, year).between(first, last)


def since_year(df: DataFrame, year: Column | str, first: int) -> Column:
    """Whether a row falls in ``first`` or any later year, without an upper end."""
    if _is_date(df, year):
        return F.col(year) >= _day(first, 1)
    return year_column(df, year) >= first


def not_in_years(df: DataFrame, year: Column | str, years: Sequence[int]) -> Column:
    """Whether a row falls outside all of the years, in the same pushable form."""
    keep = F.lit(True)
    for one in years:
        outside = (F.col(year) < _day(one, 1)) | (F.col(year) >= _day(one + 1, 1)) if _is_date(df, year) \
            else year_column(df, year) != one
        keep = keep & outside
    return keep


def split_year_month(stamp: Column | str) -> tuple[Column, Column]:
    """``YYYYMM`` (number or text) cut after the fourth character into year and month."""
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    text = stamp.cast("string")
    return (F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 2).try_cast("int"))
