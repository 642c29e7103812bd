"""Stretches of words that repeat with a period, by recompression.

Words become numbers; block and pair compression in turn shrink their sequence to a run-length grammar
in which equal stretches have equal symbols but for a few at their edges. A harmonic grid proposes
places and periods, and the grammar answers how far each stretch really extends to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A run has at least this many words and this many periods.
SHORTEST, TIMES = 24, 3
# Words whose grammar is built at once, and extensions asked at once.
WORDS, ASKED = 1 << 19, 1 << 19
# Words that must agree at a grid place before the grammar is asked.
GRAM = 4
# Odd factors that split the symbols of a level into left and right ones.
SIDES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 on in place of keys, and how many there are."""
    distinct, numbers = np.unique(keys, return_inverse=True)
    return numbers.astype(np.int64), len(distinct)


class Level:
    """One sequence of symbols; ``first`` has where each symbol of the next level starts, ``parent`` which one holds each."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, blocks: bool):
        self.symbols, self.blocks = symbols, blocks
        self.first = np.append(starts, len(symbols))
        self.parent = np.repeat(np.arange(len(starts)), np.diff(self.first))


class Grammar:
    """Levels of block and pair compression in turn, until no symbol occurs twice.

    The sequence must begin and end with symbols that occur once, so that no extension leaves it.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        symbols, count = dense(symbols)
        while count < len(symbols):
            symbols, count = self._shrink(symbols, count, np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])), True)
            if count < len(symbols):
                symbols, count = self._shrink(symbols, count, self._pairs(symbols), False)
        self.top = symbols

    def _shrink(self, symbols: np.ndarray, count: int, starts: np.ndarray, blocks: bool) -> tuple[np.ndarray, int]:
        if len(starts) == len(symbols):
            return symbols, count
        self.levels.append(Level(symbols, starts, blocks))
        sizes = np.diff(self.levels[-1].first)
        # A block is known by its symbol and length, a pair by both its symbols.
        tail = sizes if blocks else np.where(sizes == 2, symbols[self.levels[-1].first[1:] - 1] + 1, 0)
        return dense(symbols[starts] * (max(int(tail.max()), count) + 1) + tail)

    @staticmethod
    def _pairs(symbols: np.ndarray) -> np.ndarray:
        """Starts after joining each left symbol with a right one behind it; the split that joins most is taken."""
        best = None
        for factor in SIDES:
            side = ((symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(factor)) >> np.uint64(13) & np.uint64(1)
            for left in (0, 1):
                joined = (side[:-1] == left) & (side[1:] != left)
                if best is None or joined.sum() > best.sum():
                    best = joined
        if not best.any():
            # Where no split joins anything, the most frequent of the symbols that have a neighbour is the one left symbol.
            best = symbols[:-1] == np.bincount(symbols[:-1]).argmax()
        return np.flatnonzero(np.append(True, ~best))

    def extensions(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from places ``a`` and ``b`` on, to the right (``step`` 1) or to the left (-1).

        Up the levels as long as both places are at edges of symbols, past at most one symbol or block on
        each, then down where they differ.
        """
        start, a, b = a, a.copy(), b.copy()
        stopped = np.full(len(a), len(self.levels))
        going = np.arange(len(a))
        for k, level in enumerate(self.levels):
            at = going
            while len(at):
                # What is at an edge goes up; what is not moves on while it agrees.
                loose = at[~(level_edge(level, a[at], step) & level_edge(level, b[at], step))]
                same = level.symbols[a[loose]] == level.symbols[b[loose]]
                stopped[loose[~same]] = k
                at = loose[same]
                move(level, a, b, at, step)
            going = going[stopped[going] > k]
            a[going], b[going] = level.parent[a[going]], level.parent[b[going]]
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            at = np.flatnonzero(stopped > k)
            for place in (a, b):
                place[at] = level.first[place[at]] if step > 0 else level.first[place[at] + 1] - 1
            at = at[level.symbols[a[at]] == level.symbols[b[at]]]
            while len(at):
                move(level, a, b, at, step)
                at = at[level.symbols[a[at]] == level.symbols[b[at]]]
        return (a - start) * step


def level_edge(level: Level, at: np.ndarray, step: int) -> np.ndarray:
    """Whether places are where a symbol of the next level begins, seen in the direction of ``step``."""
    parent = level.parent[at]
    return level.first[parent] == at if step > 0 else level.first[parent + 1] - 1 == at


def move(level: Level, a: np.ndarray, b: np.ndarray, at: np.ndarray, step: int) -> None:
    """Go past what agrees: one symbol, or the shorter rest of two blocks of it."""
    if level.blocks:
        rests = [level.first[level.parent[p[at]] + 1] - p[at] if step > 0 else p[at] - level.first[level.parent[p[at]]] + 1
                 for p in (a, b)]
        by = np.minimum(*rests) * step
    else:
        by = step
    a[at] += by
    b[at] += by


def candidates(numbers: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places and periods at which words repeat on a harmonic grid, for texts in order of length, longest first.

    Of a run of length L or more, L - period words in a row equal the word a period later, so one place of
    a grid that fine has ``GRAM`` of them behind it. The grids of all periods together have about n log n places.
    """
    sizes = np.diff(np.append(0, ends))
    gram = np.zeros(len(numbers), np.uint64)
    for i in range(GRAM):
        gram[:len(numbers) - i] = gram[:len(numbers) - i] * np.uint64(0x9E3779B97F4A7C15) + numbers[i:].astype(np.uint64)
    for period in range(1, int(sizes[0]) // TIMES + 1):
        least = max(SHORTEST, TIMES * period)
        # Texts that are too short for this period are all behind those that are not.
        texts = int(np.searchsorted(-sizes, -least, "right"))
        if not texts:
            break
        upto, grid = int(ends[texts - 1]), least - period - GRAM + 1
        later = gram[period:upto:grid]
        yield np.flatnonzero(gram[:upto:grid][:len(later)] == later) * grid, period


def runs_of(texts: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run of every text, by text, start and period.

    Only texts with a grid place that repeats enter the grammar; the others have no run.
    """
    order = sorted((i for i, words in enumerate(texts) if len(words) >= SHORTEST), key=lambda i: -len(texts[i]))
    if not order:
        return []
    known: dict[bytes, int] = {}
    rows = [np.fromiter((known.setdefault(w, len(known)) for w in texts[i]), np.int64, len(texts[i])) for i in order]
    # Between texts, and around all of them, are symbols that occur once.
    parts = [np.append(row, -2 - at) for at, row in enumerate(rows)]
    ends = np.cumsum([len(part) for part in parts])
    numbers = np.concatenate(parts)
    found = [(place, np.full(len(place), period)) for place, period in candidates(numbers, ends) if len(place)]
    if not found:
        return []
    place, period = (np.concatenate(column) for column in zip(*found))
    home = np.searchsorted(ends, place, "right")
    # Texts that are alike also agree with each other, which is no run.
    inside = home == np.searchsorted(ends, place + period, "right")
    if not inside.any():
        return []
    place, period, home = place[inside], period[inside], home[inside]
    used = np.unique(home)
    begins = ends - [len(part) for part in parts]
    grammar = Grammar(np.concatenate([[-1], *[parts[i] for i in used]]))
    shift = np.zeros(len(parts), np.int64)
    shift[used] = 1 + np.cumsum([0, *[len(parts[i]) for i in used[:-1]]]) - begins[used]
    here = place + shift[home]
    spans = []
    for at in range(0, len(here), ASKED):
        i, p = here[at:at + ASKED], period[at:at + ASKED]
        back = grammar.extensions(i - 1, i + p - 1, -1)
        ahead = grammar.extensions(i, i + p, 1)
        long = back + p + ahead >= np.maximum(SHORTEST, TIMES * p)
        h = home[at:at + ASKED]
        spans.append(np.stack([h, i - back - shift[h] - begins[h], back + p + ahead, p], 1)[long])
    spans = np.concatenate(spans)
    if not len(spans):
        return []
    # A multiple of a period gives the same stretch; the smallest is the period.
    spans = spans[np.lexsort(spans.T[::-1])]
    spans = spans[np.append(True, (spans[1:, :3] != spans[:-1, :3]).any(axis=1))]
    spans[:, 0] = np.array(order)[spans[:, 0]]
    return [tuple(row) for row in spans[np.lexsort(spans.T[[3, 1, 0]])].tolist()]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run only repeats."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` per input row.

    ``runs`` are (start, length, period) in words, by start, then period: each stretch of at least 24 words and
    three periods that no word beside it extends. ``collapsed`` has the words, joined by one space, without
    those of a run behind its first period. A missing or empty text has no runs and an empty ``collapsed``;
    rows that repeat an id are answered each; an empty table gives no rows. One pass over the scan's batches,
    no shuffle; a task holds the words of ``WORDS`` at a time, or of one longer text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, *run in runs_of(texts):
            runs[i].append(tuple(run))
        collapsed = [b" ".join(kept_words(words, found)) for words, found in zip(texts, runs)]
        shown = [[dict(zip(("start", "length", "period"), run)) for run in found] for found in runs]
        return pa.RecordBatch.from_arrays([ids, pa.array(shown, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())],
                                          ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, start = [], 0, 0
            for at, body in enumerate(batch.column(1)):
                # Bytes split at exactly the six white-space characters of ASCII.
                texts.append(body.as_py().encode().split())
                held += len(texts[-1])
                if held >= WORDS:
                    yield answer(batch.column(0)[start:at + 1], texts)
                    texts, held, start = [], 0, at + 1
            if texts:
                yield answer(batch.column(0)[start:], texts)

    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
