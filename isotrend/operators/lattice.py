"""Summaries of areas and periods at every level at once, also of measures that do not add up.

A mean, a strict mean, an extreme with its ties and a quantile of all months cannot be had from those of the
months. What can be added up are the counts of the distinct values, so the rows are reduced to these once, at the
finest level, and every coarser level is counted from that reduction.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.functions.values import named
from isotrend.operators.joins import left_join
from isotrend.operators.order_stats import at_rank
from isotrend.operators.reshape import present
from isotrend.session import stored

ALL = "All"


def _levels(columns: Sequence[str], total: str) -> list[list[Column]]:
    """The columns' values at each level, finest first: at the next the first column is the total, at the last all are."""
    return [[F.lit(total).alias(c) if i < k else F.col(c).cast("string").alias(c) for i, c in enumerate(columns)]
            for k in range(len(columns) + 1)]


def lattice_summary(df: DataFrame, areas: Sequence[str], times: Sequence[str], value: str,
                    probs: Sequence[float] = (0.25, 0.5, 0.75), total: str = ALL) -> DataFrame:
    """Rows, present values, mean, strict mean, extremes with their ties and exact quantiles of every level.

    ``areas`` and ``times`` go from the finest column to the coarsest, each a function of the one before (county, state;
    month, season); a level leaves out the finer ones, which then hold ``total``, and the last leaves out all. NaN counts as missing, a
    missing key is a group of its own. A group without values has a row with counts alone. Raw rows are grouped
    once; what is spread over the levels are the distinct values of the finest groups.
    """
    outer, k = [*areas, *times], len(areas)
    # Keys have names of their own from here to the result.
    keys = [f"__key{i}" for i in range(len(outer))]
    cells = stored(df.select(*[named(c).alias(a) for c, a in zip(outer, keys)], present(named(value).cast("double")).alias("v"))
                   .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")), "lattice")
    nodes = [F.struct(*a, *t) for a, t in product(_levels(keys[:k], total), _levels(keys[k:], total))]
    spread = cells.select(F.explode(F.array(*nodes)).alias("node"), "v", "c").select("node.*", "v", "c")
    counts = stored(spread.groupBy(*keys, "v").agg(F.sum("c").alias("c")), "lattice-levels")

    there = F.col("v").isNotNull()
    rows, n = F.sum("c"), F.coalesce(F.sum(F.when(there, F.col("c"))), F.lit(0))
    mean = F.try_divide(F.sum(F.col("v") * F.col("c")), F.nullif(n, F.lit(0)))
    pair = F.when(there, F.struct("v", "c"))
    # Of equal extremes there is one line with its count.
    summary = counts.groupBy(*keys).agg(
        rows.alias("rows"), n.alias("n"), mean.alias("mean"), F.when(rows == n, mean).alias("strict_mean"),
        F.max(pair).alias("__high"), F.min(pair).alias("__low"))
    at = [F.greatest(F.col("n") - 1, F.lit(0)) * F.lit(float(p)) for p in probs]
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.floor(a).alias("rank"), (a - F.floor(a)).alias("weight"))
                                for i, a in enumerate(at)])).alias("line")
    wanted = left_join(counts.filter(there), summary.select(*keys, "n"), keys).select(*keys, "v", "c", lines) \
        .select(*keys, "line.which", "v", "c", "line.rank", "line.weight")
    names = [f"q{round(p * 100)}" for p in probs]
    found = at_rank(wanted, [*keys, "which"]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("which") == i, F.col("q"))).alias(name) for i, name in enumerate(names)])
    return left_join(summary, found, keys).select(
        *[F.col(a).alias(c) for a, c in zip(keys, outer)], "rows", "n", "mean", "strict_mean", F.col("__low.v").alias("low"),
        F.col("__low.c").alias("low_rows"), F.col("__high.v").alias("high"), F.col("__high.c").alias("high_rows"), *names)
