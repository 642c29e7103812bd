"""Aggregation rules and changes of shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrend.functions.values import as_col, nan_to_null
from isotrend.operators.joins import attach


def present(value: Column | str) -> Column:
    """The value, missing where it is NaN: both mean that nothing was measured."""
    return nan_to_null(as_col(value))


def mean_of(value: Column | str) -> Column:
    """Mean of the values that are there."""
    return F.avg(present(value))


def strict_mean(value: Column | str) -> Column:
    """Mean that is missing as soon as one value of the group is missing."""
    value = present(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def mean_parts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key the sum, the present values and the rows, from which means of larger groups follow."""
    return df.groupBy(*keys).agg(F.sum(present(value)).alias("__sum"), F.count(present(value)).alias("__present"), F.count(F.lit(1)).alias("__rows"))


def means_of_parts() -> tuple[Column, Column]:
    """Strict and lenient mean of a group from ``mean_parts`` joined to its members.

    A member without rows counts as one row with a missing value, as it would in the join of all rows.
    """
    lenient = F.try_divide(F.sum("__sum"), F.nullif(F.sum("__present"), F.lit(0)))
    whole = F.count_if(F.coalesce(F.col("__present") < F.col("__rows"), F.lit(True))) == 0
    return F.when(whole, lenient), lenient


def mean_where(value: Column | str, condition: Column) -> Column:
    """Mean over the rows that meet ``condition``, in the same pass as any other aggregate."""
    return F.avg(F.when(condition, present(value)))


def value_at(value: Column | str, condition: Column) -> Column:
    """The group's value on the one row that meets ``condition``."""
    return F.max(F.when(condition, present(value)))


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None,
            name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long; missing values keep their rows."""
    columns = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    return df.unpivot(list(ids), columns, name, value)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first):names.index(last) + 1]


def drop_positions(df: DataFrame, *positions: int) -> DataFrame:
    """Drop columns by 0-based position."""
    return df.select(*[c for i, c in enumerate(df.columns) if i not in positions])


def to_wide(df: DataFrame, entity: str, name: str, value: str, names: Sequence,
            prefix: str = "") -> DataFrame:
    """Long to wide with one column per listed name; the list spares the discovery job."""
    wide = df.groupBy(entity).pivot(name, list(names)).agg(F.max(value))
    return wide.withColumnsRenamed({str(n): f"{prefix}{n}" for n in names})


def stack_tagged(tables: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Append tables by column name, filling absent columns, each row marked with its origin."""
    stacked = None
    for label, df in tables.items():
        tagged = df.withColumn(tag, F.lit(label))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked


def choice_list(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def describe_measures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column, one row each, in one pass; NaN counts as missing."""
    def line(name: str) -> Column:
        v = present(name)
        return F.struct(F.lit(name).alias("measure"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                        F.stddev_samp(v).alias("sd"), F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high"))

    lines = [f"__{i}" for i in range(len(columns))]
    return df.agg(*[line(c).alias(a) for c, a in zip(columns, lines)]).select(F.inline(F.array(*lines)))


def count_domain(df: DataFrame, label: Column, labels: Sequence[str], name: str = "label") -> DataFrame:
    """Rows per label over the whole label domain, empty labels included, in label order.

    The last row, without a label, counts the rows in no bin: missing or out of range. So the
    counts always add up to the rows.
    """
    counts = [F.count_if(F.coalesce(F.col("__label") == x, F.lit(False))) for x in labels]
    other = F.count_if(~F.coalesce(F.col("__label").isin(*labels), F.lit(False)))
    lines = [F.struct(F.lit(i).alias("ordinal"), F.lit(x).cast("string").alias(name), n.alias("n"))
             for i, (x, n) in enumerate(zip([*labels, None], [*counts, other]), 1)]
    found = df.select(label.alias("__label"))
    return found.agg(*[line.alias(f"__{i}") for i, line in enumerate(lines)]) \
        .select(F.inline(F.array(*[f"__{i}" for i in range(len(lines))]))).orderBy("ordinal")


def with_total_sums(df: DataFrame, keys: Sequence[str], within: str, sums: Mapping[str, Column],
                    total: str = "All Months") -> DataFrame:
    """Each ``within`` group and the total over all of them, for aggregates that are sums or counts.

    Raw rows are aggregated once, to the parts; only the parts, a handful per group, are added up.
    """
    label = F.col(within).cast("string").alias(within)
    parts = df.groupBy(*keys, label).agg(*[c.alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    first = F.row_number().over(whole.orderBy(within)) == 1
    own = F.struct(F.col(within), *sums)
    merged = F.struct(F.lit(total).alias(within), *[F.sum(n).over(whole).alias(n) for n in sums])
    rows = parts.select(*keys, own.alias("__own"), merged.alias("__all"), first.alias("__first"))
    return rows.select(*keys, F.explode(F.when(F.col("__first"), F.array("__own", "__all")).otherwise(F.array("__own")))
                       .alias("__row")).select(*keys, "__row.*")


def with_total_group(df: DataFrame, keys: Sequence[str], within: str, aggregates: Sequence[Column],
                     total: str = "All Months") -> DataFrame:
    """Each ``within`` group and, beside it, the total over all of them, from one scan."""
    full = [F.col(k) for k in keys]
    grouped = df.groupingSets([full, full + [F.col(within)]], *full, F.col(within)) \
                .agg(F.grouping(within).alias("__is_total"), *aggregates)
    label = F.when(F.col("__is_total") == 1, F.lit(total)).otherwise(F.col(within).cast("string"))
    return grouped.withColumn(within, label).drop("__is_total")


def group_extremes(df: DataFrame, keys: Sequence[str], value: str, largest: bool = True) -> DataFrame:
    """Rows that hold their group's extreme value: ties stay, missing values never qualify.

    The extreme is aggregated map-side and joined back, so a group of any size stays spread
    over its partitions; ranking it would put the whole group into one task.
    """
    pick = F.max if largest else F.min
    best = df.groupBy(*keys).agg(pick(present(value)).alias("__best"))
    return attach(df, best, keys).filter(F.col(value) == F.col("__best")).drop("__best")


def rows_before(entity: str | Sequence[str], order: str, offset: int) -> Window:
    """Window over the row whose ``order`` is exactly ``offset`` less; a gap finds nothing."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(-offset, -offset)
