"""Near duplicates by SimHash: exact comparison of fingerprints in tiles, then connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import keep_rows
from isotrend.session import settle

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
# Fingerprints of a bucket that are compared in one task; larger buckets are cut into tiles of this size.
TILE = 8192
# Hashes whose bits are counted at once, and rows of a tile compared at once.
CHUNK = 1 << 15
ROWS = 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text over its word shingles, repeats included; 0 without words."""
    # bytes.lower() changes A-Z alone and bytes.split() cuts at the six ASCII white-space characters.
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths).tolist(), ends[shingle - 1:].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` per input row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       F.col(text).cast("binary").alias("body"))

    def run(batches):
        for batch in batches:
            fps = [fingerprint(body.as_py()) for body in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                                             ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of linked positions; afterwards ``label`` names the smallest position of each class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def apart(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Bits in which each fingerprint of the first differs from each of the second; both have a row of 64-bit words each."""
    bits = np.bitwise_count(rows[:, None, 0] ^ columns[None, :, 0])
    if rows.shape[1] > 1:
        bits = bits.astype(np.int16)
        for word in range(1, rows.shape[1]):
            bits += np.bitwise_count(rows[:, None, word] ^ columns[None, :, word])
    return bits


def tile_links(values: np.ndarray, radius: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of a tile (or of two tiles) that differ in at most ``radius`` bits.

    A fingerprint is a 64-bit word, or a row of several. They are put in order of their population counts. Blocks of rows meet only those
    columns whose counts are within the radius; they are compared by exclusive-or and bit count.
    Of the links found, a spanning forest is returned: at most one per fingerprint.
    """
    everything = values if other is None else np.concatenate([values, other])
    if len(everything) < 2:
        return everything[:0], everything[:0]
    words = everything.reshape(len(everything), -1)
    counts = np.bitwise_count(words).sum(axis=1, dtype=np.int16)
    label = np.arange(len(everything))
    left = np.argsort(counts[:len(values)], kind="stable")
    right = left if other is None else np.argsort(counts[len(values):], kind="stable") + len(values)
    right_counts = counts[right]
    for at in range(0, len(left), ROWS):
        rows = left[at:at + ROWS]
        low = np.searchsorted(right_counts, counts[rows[0]] - radius, "left")
        if other is None:
            low = max(low, at)
        high = np.searchsorted(right_counts, counts[rows[-1]] + radius, "right")
        columns = right[low:high]
        i, j = np.nonzero(apart(words[rows], words[columns]) <= radius)
        merge(label, rows[i], columns[j])
    moved = label != np.arange(len(everything))
    return everything[moved], everything[label[moved]]


def _masks(count: int, radius: int, tile: int) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree on at least one of them.

    The bits are cut into blocks; those that differ touch at most ``radius`` blocks, so all bits of
    some choice of the other blocks agree. More blocks are used for more fingerprints, so that the
    fingerprints that share a mask's value stay near one tile.
    """
    for blocks in range(radius + 1, BITS + 1):
        agreeing = blocks - radius
        if agreeing == BITS - radius or count / 2 ** (BITS * agreeing / blocks) <= tile / 4:
            break
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    signed = [sum(chosen) for chosen in combinations(parts, agreeing)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in signed]


def near_links(values: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``fp`` within the radius, through those between them.

    Fingerprints meet where they agree on a mask (see ``_masks``), which loses no pair. A bucket of
    up to ``tile`` fingerprints is compared in one task. A larger one is cut by population count and
    hash into tiles; each pair of tiles whose counts are within the radius is one piece of work, the
    others are skipped. All are exact, none leaves a pair out.
    """
    masks = _masks(values.count(), radius, tile)
    places = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))
                                 for t, mask in enumerate(masks)]))
    entries = values.select("fp", F.bit_count("fp").alias("p"), places.alias("place")).select("place.*", "fp", "p")
    return bucket_links(entries, radius, tile)


def bucket_links(entries: DataFrame, radius: int, tile: int = TILE, words: int = 1) -> DataFrame:
    """``a, b``: links that connect all fingerprints that share a bucket ``t, key`` and are within the radius.

    One row per bucket and fingerprint ``fp``: a long, or as bytes where it has several 64-bit words.
    Large buckets are cut by ``p``, which differs by no more than the bits do, and by hash.
    """
    classes = entries.groupBy("t", "key", "p").agg(F.count(F.lit(1)).alias("n"))
    large = classes.groupBy("t", "key").agg(F.sum("n").alias("n"), F.collect_list(F.struct(
        "p", F.ceil(F.col("n") / tile).cast("int").alias("k"))).alias("tiles")).filter(F.col("n") > tile).drop("n")
    placed = entries.join(large, ["t", "key"], "left")
    own = F.element_at(F.filter("tiles", lambda c: c["p"] == F.col("p")), 1)["k"]
    mine = F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(
        F.col("p") * F.lit(1 << 24) + F.pmod(F.xxhash64("fp"), own)).cast("long")
    partners = F.flatten(F.transform(
        F.filter("tiles", lambda c: F.abs(c["p"] - F.col("p")) <= radius),
        lambda c: F.transform(F.sequence(F.lit(0), c["k"] - 1), lambda i: (c["p"] * F.lit(1 << 24) + i).cast("long"))))
    work = placed.withColumn("mine", mine).select(
        "t", "key", "mine", "fp", F.explode(F.coalesce(partners, F.array(F.lit(0).cast("long")))).alias("partner"))
    pieces = work.select("t", "key", F.least("mine", "partner").alias("low"), F.greatest("mine", "partner").alias("high"),
                         "mine", "fp")
    dealt = pieces.repartition("t", "key", "low", "high").sortWithinPartitions("t", "key", "low", "high")

    def compare(group: np.ndarray, low: int, high: int):
        fps = group["fp"]
        if low == high:
            return tile_links(fps, radius)
        left = group["mine"] == low
        return tile_links(fps[left], radius, fps[~left])

    def run(batches):
        names, held = ["t", "key", "low", "high", "mine", "fp"], None
        fields = np.dtype([(name, np.int64) for name in names[:5]] + [("fp", np.uint64, (words,) if words > 1 else ())])

        def read(column):
            if words == 1:
                return column.to_numpy(zero_copy_only=False).view(np.uint64)
            return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)

        def write(fps):
            return pa.array(fps.view(np.int64)) if words == 1 else pa.array([fp.tobytes() for fp in fps], pa.binary())

        def found(rows):
            keys = np.stack([rows[n] for n in names[:4]])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                if b - a > 1:
                    yield compare(rows[a:b], rows["low"][a], rows["high"][a])

        def links(parts):
            a = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.uint64)
            b = np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([write(a), write(b)], ["a", "b"])

        for batch in batches:
            rows = np.empty(batch.num_rows, fields)
            for name in names[:5]:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            rows["fp"] = read(batch.column("fp"))
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            # The last piece of work may go on in the next batch.
            last = rows[-1]
            open_from = len(rows) - int(np.argmin(np.append(np.logical_and.reduce(
                [rows[n][::-1] == last[n] for n in names[:4]]), False)))
            held = rows[open_from:]
            if open_from:
                yield links(list(found(rows[:open_from])))
        if held is not None and len(held):
            yield links(list(found(held)))

    return dealt.mapInArrow(run, "a long, b long" if words == 1 else "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of the links: the smallest node that it is connected with.

    Alternates the large-star and small-star steps until nothing changes. Each round is a few
    aggregations and joins over the links; the largest part of a component never meets in one task.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter(F.col("u") > F.col("v")).distinct())
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            break
        state = found
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join deals both sides out anew and can split the edges of a hub.
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter(F.col("u") > F.col("v")).distinct()
        large = settle(large)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") > F.col("v")).distinct()
        edges = settle(small)
    labelled = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = labelled.select(F.col("label").alias("node"), "label").distinct()
    return labelled.unionByName(roots)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
                tile: int = TILE) -> DataFrame:
    """``doc_id, text_key, fingerprint, component_id`` per input row.

    Only distinct fingerprints are compared and connected, so copies cost one each however many
    there are. ``component_id`` is the smallest id reachable over links of at most ``radius`` bits.
    Texts without words (missing, empty, white space) have fingerprint zero and are linked like any
    other. A missing id never names a component; it is missing only where no row of the component
    has an id. Rows that repeat an id get the same answer each. An empty table gives no rows.
    """
    marked = settle(fingerprints(docs, doc_id, text))
    values = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = settle(components(near_links(values.select("fp"), radius, tile)))
    named = labels.join(values, F.col("node") == F.col("fp"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = labels.join(least, "label").select(F.col("node").alias("fp"), F.lit(True).alias("linked"), "component_id")
    alone = values.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(
        F.col("first_id")).alias("component_id"))
    # The table per fingerprint is written so that the join deals out both sides anew and can split hot keys.
    joined = marked.join(settle(alone), "fp", "left")
    return joined.select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with all columns of ``docs``.

    Of rows that repeat both id and text one stays.
    """
    kept = near_groups(docs, doc_id, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return keep_rows(docs, kept.select(F.col("doc_id").alias(doc_id), "text_key"), doc_id, text, once=True)
