"""Near duplicates by shingle similarity: wide SimHash fingerprints propose groups, whole shingle sets decide, then components."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import keep_rows
from isotrend.llm.simhash import bucket_links, components
from isotrend.session import settle

SHINGLE = 5
SIMILARITY = 0.8
# Chance that a pair of just that similarity is not proposed.
MISSED = 1e-4
SEED = 42
# 64-bit words of a fingerprint. At similarity 0.8 some 15 % of its bits differ, of unrelated texts half; 64 bits do not tell these apart.
WORDS = 4
WIDTH = 64 * WORDS
# Sets of fewer shingles differ in more bits at the same similarity, so they are searched with figures of their own.
FEW = 5
# Fingerprints that share a table's bits, on average of all tables; more fingerprints share more bits in more tables.
BUCKET = 2048
# Texts of a proposed group that are compared in one task; larger groups are cut into tiles of this size.
TILE = 256
# Shingles of a tile's texts, on average; long texts make more and smaller tiles, so a pair of tiles fits in a task.
TILE_SHINGLES = 1 << 21
# Hashes whose bits are counted at once.
CHUNK = 1 << 13


@cache
def bit_share(similarity: float, least: int = 1) -> float:
    """The greatest chance that a bit differs between fingerprints of two sets of at least this similarity and size."""
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi

    def chances(n):
        return np.array([math.comb(n, k) for k in range(n + 1)]) / 2 ** n

    # The angle holds for large sets; of small ones all pairs of sizes are counted out.
    for small in range(least, 33):
        for large in range(small, int(small / similarity + 1e-9) + 1):
            common = math.ceil(similarity * (small + large) / (1 + similarity) - 1e-9)
            if common > small:
                continue
            shared = np.arange(common + 1)
            ones = [np.array([chances(n - common)[max(0, n // 2 + 1 - k):].sum() for k in shared]) for n in (small, large)]
            worst = max(worst, float((chances(common) * (ones[0] * (1 - ones[1]) + ones[1] * (1 - ones[0]))).sum()))
    return worst


@cache
def search_plan(bits: int, share: float, missed: float = MISSED) -> tuple[int, int]:
    """Radius, and number of tables of this many bits, that miss a pair with at most the given chance.

    Each bit of the pair differs with the chance ``share``. Half of what may be missed lies beyond the
    radius, the other half agrees on the bits of no table.
    """
    chance = [math.comb(WIDTH, d) * share ** d * (1 - share) ** (WIDTH - d) for d in range(WIDTH + 1)]
    radius = next(r for r in range(WIDTH + 1) if sum(chance[r + 1:]) <= missed / 2)
    apart = np.array([1 - math.comb(WIDTH - d, bits) / math.comb(WIDTH, bits) for d in range(radius + 1)])
    tables = 1
    while (chance[:radius + 1] * apart ** tables).sum() > missed / 2:
        tables += 1
    return radius, tables


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles of a UTF-8 text in order; a text of fewer words is one shingle."""
    # Words as in the SimHash: A-Z in lower case, cut at the six ASCII white-space characters.
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths).tolist(), ends[shingle - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1))


def fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of a shingle set: each bit is 1 if more than half of the shingles have it, in ``WORDS`` hashes of each."""
    salts = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, np.uint64)
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), CHUNK):
        spread = hashes[at:at + CHUNK, None] + salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            spread ^= spread >> np.uint64(shift)
            spread *= np.uint64(factor)
        spread ^= spread >> np.uint64(31)
        ones += np.unpackbits(spread.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def marked_rows(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``doc_id, text_key, node, n, fp`` per input row; the node is a digest of the shingle set, which has ``n`` shingles."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       F.col(text).cast("binary").alias("body"))

    def run(batches):
        for batch in batches:
            sets = [shingles(body.as_py(), shingle) for body in batch.column(2)]
            nodes = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fingerprint(s) for s in sets], pa.binary())], ["doc_id", "text_key", "node", "n", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, node binary, "
                                "n long, fp binary")


def near_fingerprints(values: DataFrame, share: float, missed: float = MISSED) -> DataFrame:
    """``a, b``: links that connect the fingerprints ``fp`` of which a ``share`` of the bits differs, or less.

    Fingerprints meet in a table where they agree on its bits, drawn at random; there all are compared by
    exclusive-or and bit count. Few fingerprints share one table of no bits, which holds every pair.
    """
    bits = max(0, math.ceil(math.log2(max(1, values.count()) / BUCKET)))
    radius, tables = search_plan(bits, share, missed)
    draw = np.random.default_rng(SEED)
    places = [draw.choice(WIDTH, bits, replace=False) for _ in range(tables)]

    def run(batches):
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH // 8)
            lit = np.unpackbits(fps, axis=1, bitorder="little")
            for table, at in enumerate(places):
                keys = lit[:, at].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), table, np.int32)), pa.array(keys), batch.column(0),
                     pa.array(np.zeros(len(keys), np.int32))], ["t", "key", "fp", "p"])

    # The radius is wider than population counts spread, so large buckets are cut by hash alone.
    return bucket_links(values.select("fp").mapInArrow(run, "t int, key long, fp binary, p int"), radius, words=WORDS)


def similar_links(sets: list[np.ndarray], side: np.ndarray | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of sets whose Jaccard similarity is at least this, enough of them to connect all such pairs.

    With ``side`` only pairs of different sides count. Sets that earlier links connect are not compared again.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = [ids[b - n:b] for n, b in zip(sizes.tolist(), ends.tolist())]
    label, held, found = np.arange(len(sets)), np.zeros(len(names), bool), []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        open_ = (label[rest] != label[i]) & (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-9)
        if side is not None:
            open_ &= side[rest] != side[i]
        rest = rest[open_]
        if not len(rest):
            continue
        held[parts[i]] = True
        common = np.array([np.count_nonzero(held[parts[j]]) for j in rest])
        held[parts[i]] = False
        for j in rest[common >= similarity * (sizes[i] + sizes[rest] - common) - 1e-9].tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def similar_nodes(docs: DataFrame, marked: DataFrame, doc_id: str, text: str, shingle: int, similarity: float,
                  missed: float, tile: int) -> DataFrame:
    """``a, b``: links that connect all proposed nodes whose shingle sets are similar enough.

    Nodes are proposed by their fingerprints, and the components of these links hold every proposed
    pair. Only their texts are fetched, one per node. Within a component all are compared by their
    whole shingle sets, in tiles and pairs of tiles where it is large.
    """
    nodes = settle(marked.groupBy("node", "n", "fp").agg(F.min(F.struct("doc_id", "text_key")).alias("row")))
    # A pair has at least FEW shingles each, or both are among the short ones.
    short = nodes.filter(F.col("n") <= int((FEW - 1) / similarity + 1e-9)).select("fp").distinct()
    long = nodes.filter(F.col("n") >= FEW).select("fp").distinct()
    proposed = near_fingerprints(long, bit_share(similarity, FEW), missed).unionByName(
        near_fingerprints(short, bit_share(similarity), missed))
    groups = settle(components(proposed)).withColumnRenamed("node", "fp")
    one = settle(nodes.join(groups, "fp", "left").select("node", "n", "row", F.coalesce("label", "fp").alias("label")))
    tiles = settle(one.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / TILE_SHINGLES)).cast("int").alias("k"),
                                            F.count(F.lit(1)).alias("nodes")).filter("nodes > 1").drop("nodes"))
    wanted = one.join(tiles, "label").select(
        "node", "label", "k", F.col("row.doc_id").alias("want_id"), F.col("row.text_key").alias("want_key"),
        F.xxhash64("row.doc_id", "row.text_key").alias("want_row"))
    bodies = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("body"))
    bodies = bodies.withColumn("row_key", F.xxhash64("doc_id", "text_key"))
    # Missing ids are compared on top of the hash, so that rows stay dealt by it.
    alike = F.coalesce(F.col("doc_id") == F.col("want_id"), F.col("doc_id").isNull() & F.col("want_id").isNull())
    met = bodies.join(wanted, (F.col("row_key") == F.col("want_row")) & (F.col("text_key") == F.col("want_key")) & alike)
    mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    work = met.select("label", "node", "body", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("partner"))
    pieces = work.select("label", F.least("mine", "partner").alias("low"), F.greatest("mine", "partner").alias("high"),
                         "mine", "node", "body")
    dealt = pieces.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")

    def run(batches):
        key, held = None, {}

        def found():
            nodes = list(held)
            side = None if key is None or key[1] == key[2] else np.array([held[n][0] for n in nodes])
            pairs = similar_links([held[n][1] for n in nodes], side, similarity)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.binary()),
                                               pa.array([nodes[j] for _, j in pairs], pa.binary())], ["a", "b"])

        for batch in batches:
            for label, low, high, side, node, body in zip(*[batch.column(c) for c in range(6)]):
                at = (label.as_py(), low.as_py(), high.as_py())
                if at != key:
                    yield found()
                    key, held = at, {}
                if node.as_py() not in held:
                    held[node.as_py()] = (side.as_py(), shingles(body.as_py(), shingle))
        yield found()

    return dealt.mapInArrow(run, "a binary, b binary")


def near_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
              similarity: float = SIMILARITY, missed: float = MISSED, tile: int = TILE) -> DataFrame:
    """``doc_id, text_key``: the row that stands for each component of near duplicates, one per component.

    Texts are linked where the Jaccard similarity of their distinct word shingles is at least
    ``similarity``; their SimHash fingerprints propose the pairs, missing one with at most the chance ``missed``,
    and the whole sets confirm them. Texts of fewer words than a shingle are alike where all their words
    are, so texts without words (missing, empty, white space) are alike. Within a component the smallest id stands for it,
    a row without id only where none has one, and of rows that share that id the smallest text key.
    """
    marked = settle(marked_rows(docs, doc_id, text, shingle))
    labels = components(similar_nodes(docs, marked, doc_id, text, shingle, similarity, missed, tile))
    placed = marked.select("doc_id", "text_key", "node").join(labels, "node", "left")
    best = placed.groupBy(F.coalesce("label", "node").alias("group")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("row"))
    return best.select("row.doc_id", "row.text_key")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """One row of each component of near duplicates (see ``near_rows``), with all columns of ``docs``."""
    kept = near_rows(docs, doc_id, text, **rule)
    return keep_rows(docs, kept.select(F.col("doc_id").alias(doc_id), "text_key"), doc_id, text, once=True)
