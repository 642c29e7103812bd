"""Sinks for cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> str:
    """Write a table once for later readers; partition a long table by year to serve one year.

    Rows are first gathered by the partition columns, so a partition gets few files however many
    tasks made its rows; adaptive execution cuts a large partition into several of its advised size.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_bucketed(df: DataFrame, name: str, path: str, by: str, buckets: int, sort: Sequence[str] = ()) -> DataFrame:
    """Write a table that serves repeated requests by one key: its rows dealt into buckets and sorted there.

    Requests that group, window or join by ``by`` start from the buckets without an exchange; two tables with the same
    buckets join without one. One file per bucket, since the rows are dealt by the key first. ``name`` is the table's in
    the session's catalog, its files are at ``path``.
    """
    dealt = df.repartition(buckets, F.col(by))
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, by).sortBy(by, *sort).saveAsTable(name)
    return df.sparkSession.table(name)
