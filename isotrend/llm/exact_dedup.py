"""Exact duplicates by skew-safe combining of salted digest groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import keep_rows, whole_text

SALTS = 16


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; only runs that differ from one are touched."""
    return F.regexp_replace(whole_text(text), r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*", " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, text_key``.

    Texts are equal when they are identical after normalising white space. Every stage groups
    by digest and by the full text, so content itself decides:

    1. each scan task combines its own rows to one per text;
    2. those meet in groups of digest and salt, so no task gets all of a hot group;
    3. the winners of the salts meet per digest, at most one per salt.

    Only then does each row look up its digest, a narrow join whose hot keys adaptive execution
    can split. Two texts with one SHA-256 digest stop the job instead of merging.

    A missing text counts as empty. A missing id never wins against another id; where a group has
    no id at all, ``keep_id`` is missing and all its rows are kept. Rows that repeat an id count
    each, and all rows with the winning id are kept. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("__text"),
                       F.xxhash64(text).alias("text_key")).withColumn("__digest", F.unhex(F.sha2("__text", 256)))
    salted = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("__digest", "__salt", "__text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = merged.repartition("__digest").groupBy("__digest", "__text").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = winners.groupBy("__digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"),
                                             F.min("group_size").alias("group_size")) \
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two texts share a digest")).cast("bigint")))
    # A row alone in its group is its own winner and needs no partner.
    several = groups.filter(F.col("group_size") > 1) \
        .select(F.lower(F.hex("__digest")).alias("text_sha256"), "keep_id", "group_size")
    mine = rows.select("doc_id", "text_key", F.lower(F.hex("__digest")).alias("text_sha256"))
    joined = mine.join(several, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                         keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "text_key")


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``: that with the smallest id.

    A row without id stays only where the group has no id. Of rows that share the winning id, or all
    lack one, that with the smallest text key stays.
    """
    # By the digest's bytes, so that the rows are not held to the join's partitions, whose hot keys can then be split.
    kept = exact_groups(docs, doc_id, text).filter("kept").groupBy(F.unhex("text_sha256").alias("digest")) \
        .agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    return keep_rows(docs, kept.select(F.col("row.doc_id").alias(doc_id), "row.text_key"), doc_id, text, once=True)
