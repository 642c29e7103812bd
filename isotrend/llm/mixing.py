"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotrend.llm.common import WORD, same, whole_text
from isotrend.session import settle

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
# Documents that one flight takes; each leaves at most two undecided.
BLOCK = 8192
# What equal rows share.
UNIT = ["source", "doc_id", "text_key"]
EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, units, target``: shares of all words by weight, none above ``most`` times its source.

    Sources in code point order, a missing one last, get the weights in turn. What a source cannot
    take is shared among the others by weight until none is above: targets are
    min(most × size, level × weight), and the level is raised in rounds that each read one row.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    order = F.col("source").asc_nulls_last()
    # Sources are ranked by range: the place within a part plus the rows of the parts before.
    placed = settle(totals.repartitionByRange(order).sortWithinPartitions(order)
                    .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row per part of the sort.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    ranked = settle(placed.join(F.broadcast(before), part == F.col("part"))
                    .select("source", "source_size", "units", weight.alias("weight")))
    cap = most * F.col("source_size")
    total, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total / weight_sum if weight_sum else 0.0), -1
    while True:
        over = F.lit(level) * F.col("weight") >= cap
        count, used, free = ranked.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if count == capped or not free:
            break
        level, capped = (total - (used or 0)) / free, count
    target = F.least(F.lit(level) * F.col("weight"), cap.cast("double"))
    return ranked.select("source", "source_size", "units", target.alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Move inclusion probabilities in the null space of the totals until at most two are undecided.

    Three undecided documents at a time: the direction (s3 - s2, s1 - s3, s2 - s1) changes neither the
    number of documents nor their words, and a random step along it, with expectation zero, decides
    at least one. Documents of equal size trade places directly.
    """
    p, open_ = chance.tolist(), []
    s, u = size.tolist(), luck.tolist()
    for i in range(len(p)):
        if EDGE < p[i] < 1 - EDGE:
            open_.append(i)
        while len(open_) == 3 or (len(open_) == 2 and s[open_[0]] == s[open_[1]]):
            if len(open_) == 3:
                a, b, c = open_
                way = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
                if not any(way):
                    way = (1, -1, 0)
            else:
                way = (1, -1)
            up = min(((1 - p[k]) / w if w > 0 else p[k] / -w) for k, w in zip(open_, way) if w)
            down = min((p[k] / w if w > 0 else (1 - p[k]) / -w) for k, w in zip(open_, way) if w)
            # Another draw for each step, derived from the document's own.
            u[i] = (u[i] * 1664525.0 + 0.3779644730092272) % 1.0
            step = up if u[i] * (up + down) < down else -down
            for k, w in zip(open_, way):
                p[k] += step * w
                p[k] = 0.0 if p[k] < EDGE else 1.0 if p[k] > 1 - EDGE else p[k]
            open_ = [k for k in open_ if 0.0 < p[k] < 1.0]
    return np.array(p)


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few documents that a flight leaves: the choice nearest to their expected words, then number."""
    p = np.where(chance < EDGE, 0.0, np.where(chance > 1 - EDGE, 1.0, chance))
    left = np.flatnonzero((p > 0) & (p < 1))
    choices = [[(bits >> k) & 1 for k in range(len(left))] for bits in range(1 << len(left))]
    away = [(abs(sum((x - p[k]) * size[k] for x, k in zip(choice, left))), abs(sum(choice) - p[left].sum()))
            for choice in choices]
    p[left] = choices[min(range(len(choices)), key=away.__getitem__)]
    return p


def numbered(rows: DataFrame, unit: list[str], name: str) -> DataFrame:
    """Rows with their number among those equal in ``unit``, from 1, in place of ``__part``, the part of the input they came from.

    Equal rows are numbered within their part, and the parts' counts are added up, so no task gets more of them
    than one part of the input holds.
    """
    local = Window.partitionBy(*unit, "__part").orderBy("__part")
    dealt = rows.withColumn(name, F.row_number().over(local))
    earlier = Window.partitionBy(*unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(rows.groupBy(*unit, "__part").agg(F.count(F.lit(1)).alias("__n"))
                    .withColumn("__before", F.sum("__n").over(earlier)).filter("__before > 0")
                    .select(*[F.col(c).alias(f"__of{i}") for i, c in enumerate(unit)], F.col("__part").alias("__at"), "__before"))
    joined = dealt.join(before, same(dealt, before, [(c, f"__of{i}") for i, c in enumerate(unit)])
                        & (dealt["__part"] == before["__at"]), "left")
    return joined.withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("int")) \
        .drop("__part", "__at", "__before", *[f"__of{i}" for i in range(len(unit))])


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row sizes, targets of the sources, and ``source, doc_id, text_key, place, copies`` for every document.

    A document is taken floor(r) times, r being its source's target over its size, and once more
    with probability r - floor(r). These extra picks are balanced: flights over blocks of documents
    of one source keep the number of documents and of words, the two that each block leaves at most
    fly again with those of other blocks, and only the last two of a source land. Blocks follow a
    hash of the id and draws a hash of id and seed, so reruns agree, and a hot source has many blocks.

    Every row is a document of its own, also without id or with a repeated one: the id, a hash of the
    text and a place among the rows equal in both tell it from others. Documents without words have size 0 and change nothing. A missing source is a
    source, the last. An empty table gives empty results.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("text_key"),
                        F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("size"))
    rows = settle(numbered(sized.withColumn("__part", F.spark_partition_id()), UNIT, "place"))
    targets = settle(source_targets(rows))
    rates = targets.select(F.col("source").alias("__source"), "units", F.coalesce(
        F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("rate"))
    luck = F.shiftrightunsigned(F.xxhash64("doc_id", "source", "text_key", "place", F.lit(seed)), 11) / float(1 << 53)
    drawn = rows.join(rates, rows["source"].eqNullSafe(rates["__source"])).select(
        *UNIT, "place", "size", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
        luck.alias("luck"), F.ceil(F.col("units") / block).alias("blocks"))
    drawn = settle(drawn)
    schema = drawn.schema
    most = drawn.agg(F.max("blocks")).first()[0] or 1

    def decide(last: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["luck", "doc_id", "size", "text_key", "place"], kind="stable")
            size = frame["size"].to_numpy(np.float64)
            p = flight(frame["p"].to_numpy(np.float64), size, frame["luck"].to_numpy(np.float64))
            frame["p"] = land(p, size) if last else p
            return frame[schema.names]
        return run

    undecided = (F.col("p") > EDGE) & (F.col("p") < 1 - EDGE)
    done, state = drawn.filter(~undecided), drawn.filter(undecided)
    while True:
        group = [F.col("source"), F.pmod(F.xxhash64("doc_id", "text_key", "place", F.lit(seed + most)), F.col("blocks"))]
        state = settle(state.groupBy(*group).applyInPandas(decide(most == 1), schema))
        if most == 1:
            break
        done = done.unionByName(state.filter(~undecided))
        state = state.filter(undecided).withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        most = -(-2 * most // block)
    counted = done.unionByName(state).select(*UNIT, "place", (F.col("whole") + F.round("p").cast("long")).alias("copies"))
    return rows, targets, counted


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per input row: words the mix takes of it, repeats counted."""
    rows, targets, counted = copies(docs, doc_id, text, source)
    counted = counted.withColumnsRenamed({name: f"__{name}" for name in [*UNIT, "place"]})
    taken = rows.join(counted, same(rows, counted, [(name, f"__{name}") for name in [*UNIT, "place"]]), "left") \
        .drop("__source", "__doc_id", "__text_key", "__place")
    targets = targets.withColumnRenamed("source", "__source")
    return taken.join(targets, taken["source"].eqNullSafe(targets["__source"]), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("copies", F.lit(0))).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all columns of ``docs``."""
    _, _, counted = copies(docs, doc_id, text, source)
    # Rows equal in source, id and text share what they are taken together as evenly as it goes.
    shares = counted.groupBy(*[F.col(name).alias(f"__{name}") for name in UNIT]).agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).filter(F.col("__copies") > 0)
    # Written first, so that the join deals both sides out anew and can split rows of one key.
    shares = settle(shares)
    keyed = docs.withColumns({"__key": F.xxhash64(text), "__part": F.spark_partition_id()})
    joined = keyed.join(shares, same(keyed, shares, [(source, "__source"), (doc_id, "__doc_id"), ("__key", "__text_key")]))
    placed = joined.filter(F.col("__rows") == 1).drop("__part").withColumn("__place", F.lit(1)).unionByName(
        numbered(joined.filter(F.col("__rows") > 1), ["__source", "__doc_id", "__text_key"], "__place"))
    own = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__place") <= F.col("__copies") % F.col("__rows")).cast("long")
    repeated = placed.withColumn("__own", own).filter(F.col("__own") > 0) \
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own"))))
    return repeated.select(*[F.col(f"`{name}`") for name in docs.columns])
