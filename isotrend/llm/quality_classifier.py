"""Quality of texts by a convolutional network over their bytes, trained and applied in numpy.

Filters run over every window of a text's UTF-8 bytes. Chunks of windows, whose bytes overlap by a window
less one, are max-pooled, and mean and deviation of the pooled chunks give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import id_remainder, whole_text

PARTS, HELD_OUT = 5, 0
# Size of the embedding of a byte, bytes of a window, filters, units of the layer behind them.
WIDTH, WINDOW, FILTERS, HIDDEN = 8, 8, 24, 16
# Windows in a chunk; chunks of one text that training looks at, spread evenly over it.
CHUNK, TRAINED = 128, 8
# Labelled rows per class that training takes at most, those with the smallest hashes.
SAMPLE = 1500
EPOCHS, BATCH, RATE, DECAY = 14, 48, 4e-3, 1e-4
# Windows convolved at once.
BLOCK = 1 << 14
# Stands behind a text so that its last bytes begin windows too; its embedding is zero.
PAD = 256


class Network(NamedTuple):
    """Parameters: bytes to vectors, windows to filters, pooled filters to hidden units, those to one number."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


SHAPES = ((257, WIDTH), (WINDOW * WIDTH, FILTERS), (FILTERS,), (2 * FILTERS + 1, HIDDEN), (HIDDEN,), (HIDDEN,), (1,))


def fresh(seed: int = 0) -> Network:
    draw = np.random.default_rng(seed)
    scale = (0.5, (WINDOW * WIDTH) ** -0.5, 0, (2 * FILTERS) ** -0.5, 0, HIDDEN ** -0.5, 0)
    net = Network(*[(draw.standard_normal(shape) * s).astype(np.float32) for shape, s in zip(SHAPES, scale)])
    net.embedding[PAD] = 0
    return net


def packed(net: Network) -> bytes:
    return np.concatenate([p.ravel() for p in net]).astype("<f4").tobytes()


def unpacked(content: bytes) -> Network:
    flat, ends = np.frombuffer(content, "<f4"), np.cumsum([int(np.prod(s)) for s in SHAPES])
    return Network(*[part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), SHAPES)])


def pooled(net: Network, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each chunk; a chunk has ``sizes`` windows, chunk behind chunk.

    A window begins at every symbol that is no padding.
    """
    out = np.empty((len(sizes), FILTERS), np.float32)
    starts, ends = np.flatnonzero(symbols != PAD), np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        low = ends[at] - sizes[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        here = starts[low:ends[upto - 1]]
        vectors = net.embedding[symbols[here[0]:here[-1] + WINDOW]].ravel()
        rows = np.lib.stride_tricks.sliding_window_view(vectors, WINDOW * WIDTH)[::WIDTH]
        response = rows[here - here[0]] @ net.filters
        out[at:upto] = np.maximum.reduceat(response, ends[at:upto] - sizes[at:upto] - low, axis=0)
        at = upto
    return np.maximum(out + net.bias, 0)


def combined(chunks: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of the chunks of each text and the log of its bytes; also both by themselves."""
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(chunks, starts, axis=0) / counts[:, None]
    away = chunks - np.repeat(mean, counts, axis=0)
    deviation = np.sqrt(np.add.reduceat(away * away, starts, axis=0) / counts[:, None] + 1e-6)
    return np.concatenate([mean, deviation, np.log1p(sizes)[:, None] / 8], axis=1).astype(np.float32), away, deviation


def probability(net: Network, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1, and the hidden units behind it."""
    units = np.maximum(features @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-np.clip(units @ net.out + net.out_bias, -30, 30))), units


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts that are not empty, each with padding behind it, windows per chunk, and chunks per text."""
    sizes = np.array([len(t) for t in texts])
    pad = np.full(WINDOW - 1, PAD, np.int16)
    symbols = np.concatenate([part for t in texts for part in (np.frombuffer(t, np.uint8).astype(np.int16), pad)])
    counts = -(-sizes // CHUNK)
    chunks = np.full(counts.sum(), CHUNK)
    chunks[np.cumsum(counts) - 1] = sizes - CHUNK * (counts - 1)
    return symbols, chunks, counts


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Score of each text; an empty one counts as a single space."""
    texts = [t or b" " for t in texts]
    symbols, chunks, counts = cut(texts)
    features = combined(pooled(net, symbols, chunks), counts, np.array([len(t) for t in texts], np.float32))[0]
    return probability(net, features)[0]


def excerpt(text: bytes) -> list[bytes]:
    """Up to ``TRAINED`` chunks of a text, with the bytes that their windows need, spread evenly from its start to its end."""
    text = text or b" "
    places = np.arange(-(-len(text) // CHUNK))
    if len(places) > TRAINED:
        places = np.unique(np.linspace(0, len(places) - 1, TRAINED).round().astype(int))
    return [text[p * CHUNK:(p + 1) * CHUNK + WINDOW - 1] for p in places]


def train(excerpts: list[list[bytes]], sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> Network:
    """Fit by stochastic gradient steps (Adam) on weighted cross-entropy; only the largest window of a chunk is corrected."""
    net, draw = fresh(seed), np.random.default_rng(seed)
    reach = CHUNK + WINDOW - 1
    counts = np.array([len(e) for e in excerpts])
    begins = np.cumsum(counts) - counts
    flat = [c for e in excerpts for c in e]
    # Every chunk in a row of its own, padded to full length.
    grid = np.full((len(flat), reach), PAD, np.int16)
    for row, c in zip(grid, flat):
        row[:len(c)] = np.frombuffer(c, np.uint8)
    weights = weights / weights.mean()
    first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    total = EPOCHS * -(-len(excerpts) // BATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(len(excerpts))
        for at in range(0, len(order), BATCH):
            picked = order[at:at + BATCH]
            n = counts[picked]
            rows = grid[np.repeat(begins[picked] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            vectors = net.embedding[rows]
            view = np.lib.stride_tricks.sliding_window_view(vectors.reshape(len(rows), -1), WINDOW * WIDTH, axis=1)[:, ::WIDTH]
            response = (np.ascontiguousarray(view).reshape(-1, WINDOW * WIDTH) @ net.filters).reshape(len(rows), CHUNK, FILTERS)
            # No window begins in the padding.
            response[rows[:, :CHUNK] == PAD] = -np.inf
            best = response.argmax(axis=1)
            top = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + net.bias
            chunks = np.maximum(top, 0)
            features, away, deviation = combined(chunks, n, sizes[picked])
            p, units = probability(net, features)
            # Backward, layer by layer.
            d_out = ((p - labels[picked]) * weights[picked] / len(picked)).astype(np.float32)
            d_units = d_out[:, None] * net.out * (units > 0)
            d_features = d_units @ net.hidden.T
            share = np.repeat(d_features / n[:, None], n, axis=0)
            d_chunks = share[:, :FILTERS] + share[:, FILTERS:2 * FILTERS] * away / np.repeat(deviation, n, axis=0)
            d_top = (d_chunks * (top > 0)).astype(np.float32)
            chosen = view[np.arange(len(rows))[:, None], best]
            d_filters = np.einsum("cfw,cf->wf", chosen, d_top)
            d_windows = (d_top[:, :, None] * net.filters.T).reshape(-1, WINDOW, WIDTH)
            places = rows[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(WINDOW)].reshape(-1)
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, places, d_windows.reshape(-1, WIDTH))
            d_embedding[PAD] = 0
            gradients = (d_embedding, d_filters, d_top.sum(axis=0), features.T @ d_units, d_units.sum(axis=0),
                         units.T @ d_out, d_out.sum(keepdims=True))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for value, g, a, b in zip(net, gradients, first, second):
                g = g + DECAY * value
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                value -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
            net.embedding[PAD] = 0
    return net


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """``label, weight, size, chunks`` of at most ``sample`` labelled rows per class that are not held out.

    Ids are chosen from the labels alone, so what is broadcast to the scan of the texts is at most twice ``sample``
    ids; should documents repeat an id, the rows with the smallest hashes stay, again at most ``sample``. A text is
    reduced to its excerpt where it is read. Rows of a class weigh what brings its share back to that of all labels.
    """
    fit = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")) \
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (id_remainder("id", PARTS) != HELD_OUT))
    count = F.count(F.lit(1))
    counts = {r.label: r.n for r in fit.groupBy("label").agg(count.alias("n")).collect()}

    def smallest(rows: DataFrame, *order: str) -> DataFrame:
        return rows.filter("label = 0").orderBy(*order).limit(sample).unionByName(
            rows.filter("label = 1").orderBy(*order).limit(sample))

    chosen = smallest(fit.distinct().withColumn("place", F.xxhash64("id")), "place", "id")
    found = docs.select(F.col(doc_id).alias("id"), whole_text(text).cast("binary").alias("text")) \
        .join(F.broadcast(chosen), "id").select("label", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([excerpt(t) for t in texts], pa.list_(pa.binary()))], ["label", "place", "size", "chunks"])

    rows = smallest(found.mapInArrow(run, "label int, place long, size long, chunks array<binary>"), "place", "size", "chunks")
    weight = F.when(F.col("label") == 0, counts.get(0, 0)).otherwise(counts.get(1, 0)) / F.lit(max(1, sum(counts.values())))
    return rows.withColumn("weight", weight.cast("double"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> bytes:
    """Parameters of the network, trained in one task on a sample of bounded size; nothing if there are no labels.

    With labels of one class only, all texts count as that class.
    """
    rows = training_rows(docs, labels, doc_id, text, label, sample).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in batch.to_pylist()]
        found.sort(key=lambda r: (r["place"], r["label"], r["size"], r["chunks"]))
        if not found:
            return
        truth = np.array([r["label"] for r in found], np.float32)
        share = np.array([r["weight"] for r in found])
        for one in (0, 1):
            share[truth == one] /= max(1, (truth == one).sum())
        net = train([r["chunks"] for r in found], np.array([r["size"] for r in found], np.float32), truth, share)
        yield pa.RecordBatch.from_arrays([pa.array([packed(net)], pa.binary())], ["net"])

    return next((bytes(r.net) for r in rows.mapInArrow(run, "net binary").collect()), b"")


def score(docs: DataFrame, net: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score`` per input row: the network over all bytes of the text.

    A missing text counts as empty, an empty one as a space; without a network every score is 0.5. Rows that
    repeat an id are answered each; an empty table gives no rows. One pass over the scan's batches, no shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (id_remainder(doc_id, PARTS) == HELD_OUT).alias("held_out"),
                       whole_text(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(net) if net else None
        for batch in batches:
            found, held, size = [np.empty(0)], [], 0
            for value in batch.column(2):
                held.append(value.as_py())
                size += len(held[-1])
                if size >= 64 * BLOCK:
                    found.append(scores(model, held) if model else np.full(len(held), 0.5))
                    held, size = [], 0
            if held:
                found.append(scores(model, held) if model else np.full(len(held), 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(found).astype(float))],
                                             ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             sample: int = SAMPLE) -> DataFrame:
    """Learn from labelled rows that are not held out, then score every document."""
    return score(docs, fit(docs, labels, doc_id, text, label, sample), doc_id, text)
