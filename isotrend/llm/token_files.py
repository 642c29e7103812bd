"""Token ids as Parquet lists that allow selective reads of tokens and metadata."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isotrend.llm.tokens import shipped, worker_encoder

END = 0
TEXTS = 256
# Format of the files. Ids are few and skewed, so the dictionary encoding packs them to their bits; where a
# page does not profit, and for the ascending columns, the second format version writes deltas. Row
# groups are bounded in bytes and pages in rows, and each page's bounds are in the page index, so a
# reader of a few documents touches a few pages.
FORMAT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.columnindex.truncate.length": "64",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str | None = None, end_id: int = END) -> None:
    """Tokenize whole texts and write them in ascending id order, ``end_id`` after each document.

    Columns: ``doc_id``, ``ids`` (list of int), ``n_tokens``, ``part`` (number of the range) and ``first``
    (ids before the document within its range). Ranges follow sampled bounds of the id, so they are
    even whatever the sources are; rows that repeat an id are documents of their own and are kept
    in an order fixed by their text. A missing text is empty: only the end id. Missing ids come first.
    """
    content = shipped(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, first, part = worker_encoder(content.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(at, TEXTS)
                arrays = [np.append(ids, np.uint32(end_id)) for ids in encoder.encode(piece.column(1))]
                sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), ids, pa.array(sizes), pa.array(np.full(len(arrays), part, np.int32)),
                     pa.array(first + ends[:-1])], ["doc_id", "ids", "n_tokens", "part", "first"])
                first += int(ends[-1])

    encoded = ranged.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, part int, first long")
    encoded.write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The written documents with ``start``, the ids of all documents before; reads only the columns asked for.

    A range's total is its last document's ``first + n_tokens``, so the offsets come from two narrow columns;
    they are one row per range.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    wanted = columns or ["doc_id", "start", "n_tokens", "ids"]
    joined = files.join(F.broadcast(before), "part")
    return joined.withColumn("start", F.col("before") + F.col("first")).select(*wanted)


def with_crc(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: unsigned crc32 of a document's ids, little-endian 32 bits each."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            edges = lists.offsets.to_numpy().tolist()
            crcs = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
