"""Left joins: missing keys match, and only the planner decides on broadcasts, by size in bytes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.functions.values import named


def _as_pairs(on: str | Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    if isinstance(on, Mapping):
        return list(on.items())
    return [(k, k) for k in ([on] if isinstance(on, str) else on)]


def left_join(df: DataFrame, other: DataFrame, on: str | Sequence[str] | Mapping[str, str],
              null_safe: bool = True, how: str = "left") -> DataFrame:
    """Left outer equi-join that keeps the left key columns once.

    ``on`` is a name, a list of names, or ``{left name: right name}``. With ``null_safe``
    a missing key matches a missing key; duplicate right keys multiply rows.
    """
    pairs = _as_pairs(on)
    tagged = other.withColumnsRenamed({right: f"__right_{right}" for _, right in pairs})
    sides = [(named(left), named(f"__right_{right}")) for left, right in pairs]
    terms = [a.eqNullSafe(b) if null_safe else a == b for a, b in sides]
    joined = df.join(tagged, reduce(lambda a, b: a & b, terms), how)
    return joined.drop(*[f"__right_{right}" for _, right in pairs])


def attach(df: DataFrame, lookup: DataFrame, keys: str | Sequence[str], null_safe: bool = True) -> DataFrame:
    """Add the columns of a one-row-per-key ``lookup`` to every row of a large ``df``.

    A plain left join, so filters on ``df`` reach its scan and ``df`` is read once. Whether the
    lookup is broadcast is for the planner, which does so only below the session's limit in bytes:
    by its estimate, or by the size it measures while the query runs. Otherwise both sides shuffle,
    and adaptive execution splits the partitions in which hot keys of ``df`` meet their one row.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return left_join(df, lookup, keys, null_safe)


def join_drivers(base: DataFrame, drivers: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-deep chain of left joins of driver tables onto ``base`` by one key.

    Every driver is one row per key (a yearly table), so Catalyst broadcasts the short ones
    and sort-merges any that is not.
    """
    return reduce(lambda left, right: left_join(left, right, key), drivers, base)


def area_attributes(areas: DataFrame, attributes: DataFrame,
                    on: str | Sequence[str] | Mapping[str, str],
                    exclude: Column | None = None) -> DataFrame:
    """Every area with its attributes, NULL where it has none; excluded areas are left out."""
    kept = areas if exclude is None else areas.filter(~F.coalesce(exclude, F.lit(False)))
    return left_join(kept, attributes, on)
