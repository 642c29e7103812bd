"""Labels, bins, clamps and text, with missing values kept missing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = math.inf

# Bin edges and labels of the maps.
PERIOD_BREAKS = (-INF, -10, -5, 0, 5, 10, 15, INF)
PERIOD_LABELS = ("<= -10", "-10 to -5", "-5 to 0", "0 to 5", "5 to 10", "10 to 15", "> 15")
CHANGE_BREAKS = (-20, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 20)
CHANGE_LABELS = ("More than -5", "-5 to -4", "-4 to -3", "-3 to -2", "-2 to -1", "-1 to 0",
                 "0 to 1", "1 to 2", "2 to 3", "3 to 4", "4 to 5", "More than 5")
FINE_CHANGE_BREAKS = (-20, -2.5, -2, -1.5, -1, -0.5, 0, 0.5, 1, 1.5, 2, 2.5, 20)
FINE_CHANGE_LABELS = ("More than -2.5", "-2.5 to -2", "-2 to -1.5", "-1.5 to -1", "-1 to -.5",
                      "-.5 to 0", "0 to .5", ".5 to 1", "1 to 1.5", "1.5 to 2", "2 to 2.5",
                      "More than 2.5")
LEVEL_BREAKS = (0, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 100)
LEVEL_LABELS = ("Below 30", "30-35", "35-40", "40-45", "45-50", "50-55", "55-60", "60-65",
                "65-70", "70-75", "Above 75")


def named(name: str) -> Column:
    """The column of exactly this name, dots, spaces and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_col(value: Column | str) -> Column:
    return named(value) if isinstance(value, str) else value


def nan_to_null(value: Column | str) -> Column:
    """NaN becomes NULL, so that one NaN cannot poison a sum or a regression."""
    value = as_col(value)
    return F.when(~F.isnan(value), value)


def sentinel_to_null(value: Column | str, *sentinels: float) -> Column:
    """Declared missing-value codes (-99, -999) become NULL."""
    value = as_col(value)
    return F.when(~value.isin(*sentinels), value)


def sign_label(value: Column | str, negative: str = "red", other: str = "blue") -> Column:
    """``negative`` below zero, ``other`` from zero up, NULL for a missing value."""
    value = as_col(value)
    return F.when(value < 0, negative).when(value >= 0, other)


def recode(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace the listed category labels; other labels pass through."""
    value = as_col(value)
    result = value
    for old, new in mapping.items():
        result = F.when(value == old, new).otherwise(result)
    return result


def round_all(df: DataFrame, columns: Sequence[str], places: int) -> DataFrame:
    """Round the listed measure columns, ties to even."""
    return df.withColumns({c: F.bround(named(c), places) for c in columns})


def bin_index(value: Column | str, breaks: Sequence[float], right: bool = True) -> Column:
    """1-based bin of ``value``; NULL when missing or outside the breaks.

    ``right=True`` means ``(a, b]`` bins, ``right=False`` means ``[a, b)``. An infinite
    outer break leaves that side open; NaN sorts above infinity and so falls in no bin.
    """
    value = as_col(value)
    inside = (value > float(breaks[0])) & (value <= float(breaks[-1])) if right else \
        (value >= float(breaks[0])) & (value < float(breaks[-1]))
    index = F.lit(len(breaks) - 1)
    for i in range(len(breaks) - 2, 0, -1):
        edge = float(breaks[i])
        index = F.when(value <= edge if right else value < edge, i).otherwise(index)
    return F.when(inside, index)


def bin_label(value: Column | str, breaks: Sequence[float], labels: Sequence[str],
              right: bool = True) -> Column:
    """Label of the bin that holds ``value``."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per bin")
    names = F.array(*[F.lit(label) for label in labels])
    return F.get(names, bin_index(value, breaks, right) - 1)


def squish(value: Column | str, low: float | Column, high: float | Column) -> Column:
    """Clamp to ``[low, high]``; a missing value stays missing."""
    value = as_col(value)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def rescale_points(points: Sequence[float], to: tuple[float, float] = (0.0, 1.0)) -> list[float]:
    """Map a short list of cut points linearly onto ``to``."""
    low, high = min(points), max(points)
    return [to[0] + (p - low) / (high - low) * (to[1] - to[0]) for p in points]


def rescale(value: Column | str, low: Column | float, high: Column | float,
            to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Map ``[low, high]`` onto ``to``; a zero-width range gives the middle of ``to``."""
    value = as_col(value)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    share = F.when(high == low, F.lit(0.5)).otherwise(F.try_divide(value - low, high - low))
    return F.when(value.isNotNull(), F.lit(to[0]) + share * (to[1] - to[0]))


def signif(value: Column | str, digits: int = 3) -> Column:
    """Round to significant digits; zero stays zero.

    Small magnitudes are scaled up, rounded and divided back; large ones use a negative
    number of places. Dividing by an exact power of ten leaves no binary dust.
    """
    value = as_col(value).cast("double")
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(value)))
    factor = F.pow(F.lit(10.0), F.abs(places))
    rounded = F.when(places >= 0, F.rint(value * factor) / factor) \
               .otherwise(F.rint(value / factor) * factor)
    return F.when(value == 0, F.lit(0.0)).when(value.isNotNull(), rounded)


def number_text(value: Column | str) -> Column:
    """A number as short text: ``20.0`` prints as ``20``, ``0.50`` as ``0.5``, ``1e27`` as ``1e+27``.

    The digits are the shortest that give the same double back. From 1e-12 to 1e15 they are
    written out, beyond with an exponent; infinities print as ``Inf`` and ``-Inf``, and only a
    missing value gives NULL.
    """
    # Adding zero turns a negative zero into zero.
    number = as_col(value).cast("double") + F.lit(0.0)
    size, short = F.abs(number), number.cast("string")
    written = F.when((size >= 1) & (size < 1e15), number.try_cast(T.DecimalType(38, 20)).cast("string")) \
        .when((size >= 1e-12) & (size < 1), number.try_cast(T.DecimalType(38, 37)).cast("string"))
    plain = F.regexp_replace(F.coalesce(F.when(short.contains("E"), written), short), r"\.0+$|(\.[0-9]*[1-9])0+$", "$1")
    exponent = F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E(?=[0-9])", "e+")
    return F.replace(F.replace(exponent, F.lit("E"), F.lit("e")), F.lit("Infinity"), F.lit("Inf"))


def label_text(*parts: Column | str | float, sep: str = "", missing: str = "NA") -> Column:
    """Paste text and columns; a missing part prints as ``missing`` instead of vanishing.

    Plain strings are literal text; pass ``F.col`` for a column. Wrap a double in
    ``number_text`` to print it without a trailing ``.0``.
    """
    pieces = [F.coalesce(p.cast("string"), F.lit(missing)) if isinstance(p, Column) else F.lit(str(p))
              for p in parts]
    return F.concat_ws(sep, *pieces)


def strip_text(value: Column | str, *patterns: str) -> Column:
    """Remove every literal occurrence of the given substrings."""
    value = as_col(value)
    for pattern in patterns:
        value = F.replace(value, F.lit(pattern), F.lit(""))
    return value
