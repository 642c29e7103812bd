"""Exact quantiles of groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrend.functions.values import named, nan_to_null
from isotrend.operators.joins import attach, left_join
from isotrend.session import settle

# Entries of the quantile sketch, whose rank error is at most rows / ACCURACY, and the
# half-width of a bracket as a share of the rows: four times that error.
ACCURACY = 10_000
HALF_WIDTH = 4e-4
# Up to this many rows a group is ranked as it is.
RANKED_ROWS = 10_000
# Cells that the distinct values of one bracket are counted into before any are ranked.
CELLS = 256


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group, exact at any size.

    Groups of up to ``RANKED_ROWS`` rows are ranked in one bounded buffer. The others take
    two passes over the rows, run when this is called. The first builds a bounded sketch that brackets each wanted
    rank between two values. The second counts the rows below each bracket and keeps the
    distinct values inside one, with their counts: under a thousandth of a large group.
    Those are counted into cells of equal numbers of values, and only the cell that holds
    the rank is put in order. The brackets and cells follow ranks, so no shape of
    distribution and no number of ties defeats them. Both ways are exact and give the same value;
    NaN counts as missing in both.
    """
    outer, keys = list(keys), [f"__key{i}" for i in range(len(keys))] or ["__key0"]
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    # Keys and value have names of their own from here to the result.
    rows = df.select(*[c.alias(k) for c, k in zip([named(k) for k in outer] or [F.lit(0)], keys)],
                     nan_to_null(named(value).cast("double")).alias("v")).filter(F.col("v").isNotNull())

    brackets = settle(_brackets(rows, probs, keys))
    counted = attach(rows, brackets, keys)
    # A group of bounded size is ranked in one buffer; the brackets serve the others.
    few = counted.filter(F.col("n") <= RANKED_ROWS).groupBy(*keys).agg(
        F.percentile("v", [float(p) for p in probs]).alias("q"))
    few = few.select(*keys, *[F.col("q")[i].alias(name) for i, name in enumerate(names)])
    shown = [F.col(k).alias(o) for k, o in zip(keys, outer)] + names
    # Where all groups are of one kind, the rows need not be read for the other.
    least, most = brackets.agg(F.min("n"), F.max("n")).first()
    if most is None or most <= RANKED_ROWS:
        return few.select(*shown)
    marked = counted.filter(F.col("n") > RANKED_ROWS)
    slots = [F.col("brackets")[i] for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [F.col("v").between(s["low"], s["high"]) for s in slots])
    below = [F.count_if(F.col("v") < s["low"]).alias(f"b{i}") for i, s in enumerate(slots)]
    cells = settle(marked.groupBy(*keys, F.when(inside, F.col("v")).alias("v")).agg(
        F.count(F.lit(1)).alias("c"), *below))

    # One line per group and quantile: its rank among the rows inside its bracket. From here
    # on tables hold a sliver of the rows, and plain joins serve.
    skipped = cells.groupBy(*keys).agg(*[F.sum(f"b{i}").alias(f"b{i}") for i in range(len(probs))])
    totals = left_join(skipped, brackets.drop("n"), keys)
    lines = [F.struct(F.lit(i).alias("which"), (s["rank"] - F.col(f"b{i}")).alias("rank"),
                      s["weight"].alias("weight"), s["low"].alias("low"), s["high"].alias("high"))
             for i, s in enumerate(slots)]
    wanted = totals.select(*keys, F.array(*lines).alias("lines"))
    spread = left_join(cells.select(*keys, "v", "c").filter(F.col("v").isNotNull()), wanted, keys) \
        .select(*keys, "v", "c", F.explode("lines").alias("line")) \
        .filter(F.col("v").between(F.col("line.low"), F.col("line.high"))) \
        .select(*keys, "line.which", "v", "c", "line.rank", "line.weight")

    found = at_rank(spread, [*keys, "which"])
    q = [F.max(F.when(F.col("which") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    large = found.groupBy(*keys).agg(*q)
    return (large if least > RANKED_ROWS else large.unionByName(few)).select(*shown)


def _brackets(rows: DataFrame, probs: Sequence[float], keys: list[str]) -> DataFrame:
    """Per group an array with the rank, interpolation weight and bracket of each quantile."""
    edges = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-HALF_WIDTH, HALF_WIDTH)]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     F.percentile_approx("v", edges, ACCURACY).alias("cuts"))
    def bracket(i: int, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        low = F.lit(float("-inf")) if p <= HALF_WIDTH else F.get("cuts", F.lit(2 * i))
        high = F.lit(float("inf")) if p >= 1 - HALF_WIDTH else F.get("cuts", F.lit(2 * i + 1))
        return F.struct(F.floor(at).alias("rank"), (at - F.floor(at)).alias("weight"),
                        low.alias("low"), high.alias("high"))

    return sketch.select(*keys, "n", F.array(*[bracket(i, p) for i, p in enumerate(probs)]).alias("brackets"))


def at_rank(spread: DataFrame, slots: list[str]) -> DataFrame:
    """The interpolated value at ``rank`` of each slot, from distinct values ``v`` with counts ``c``."""
    shares = ", ".join(f"{i / CELLS}D" for i in range(1, CELLS))
    cuts = spread.groupBy(*slots).agg(F.expr(f"percentile_approx(v, array({shares}), {ACCURACY})").alias("cuts"))
    celled = left_join(spread, cuts, slots).withColumn(
        "cell", F.size(F.filter("cuts", lambda edge: edge < F.col("v")))).drop("cuts")
    histogram = celled.groupBy(*slots, "cell").agg(F.sum("c").alias("c"), F.min("v").alias("first"),
                                                   F.first("rank").alias("rank"))
    by_cell = Window.partitionBy(*slots).orderBy("cell")
    upto = F.sum("c").over(by_cell.rowsBetween(Window.unboundedPreceding, 0))
    here = histogram.withColumns({"upto": upto, "next_first": F.lead("first").over(by_cell)}) \
        .filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))) \
        .select(*slots, F.col("cell").alias("spot"), (F.col("upto") - F.col("c")).alias("before"), "next_first")
    few = left_join(celled, here, slots).filter(F.col("cell") == F.col("spot"))
    by_value = Window.partitionBy(*slots).orderBy("v")
    after = F.col("before") + F.sum("c").over(by_value.rowsBetween(Window.unboundedPreceding, 0))
    ranked = few.withColumns({"after": after, "next": F.lead("v").over(by_value)})
    hit = ranked.filter((F.col("after") > F.col("rank")) & (F.col("after") - F.col("c") <= F.col("rank")))
    upper = F.when(F.col("rank") + 1 < F.col("after"), F.col("v")).otherwise(F.coalesce("next", "next_first", "v"))
    return hit.select(*slots, (F.col("v") + F.col("weight") * (upper - F.col("v"))).alias("q"))
