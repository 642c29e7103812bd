"""Hierarchical packing of token ids into windows of several context sizes."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrend.llm.tokens import Encoder, shipped

TIERS = (256, 512, 1024, 2048)
# Tokens of one training step: every step group holds windows of one size and as many tokens.
STEP_TOKENS = 65_536
# Rests of documents gathered before windows are filled, and those kept back to fill later gaps.
GATHERED, KEPT_BACK = 4096, 512
END = 1
TEXTS = 256
SCHEMA = ("doc_id {kind}, doc_tokens long, start long, length long, sequence_id long, offset long, tier int, "
          "step_id long, token_ids binary")


class Packer:
    """Fills windows from a stream of documents; holds at most about ``GATHERED`` rests of documents.

    A document longer than the largest window gives full windows at once. What is left of it, or a
    shorter document, goes to the smallest tier that holds it. The longest rest opens a window of its
    tier; the gap takes the longest rests of shorter tiers that fit, and what then remains of it is
    filled with the head of a rest that is cut there. So every window is full while any rest is left.
    The last tokens of a task go to windows of descending powers of two, which need no padding.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, first_id: int = 0):
        self.tiers, self.step_tokens, self.next_id = tiers, step_tokens, first_id
        # A window takes consecutive numbers, so the number of its step can be derived from its tier's count.
        self.first_id, self.windows = first_id, {}
        self.pool: list[tuple[int, int]] = []
        self.rests: dict[int, tuple] = {}
        self.serial = 0

    def _store(self, doc, total: int, start: int, ids: np.ndarray) -> None:
        self.rests[self.serial] = (doc, total, start, ids)
        insort(self.pool, (len(ids), self.serial))
        self.serial += 1

    def _take(self, at: int) -> tuple:
        return self.rests.pop(self.pool.pop(at)[1])

    def _window(self, pieces: list[tuple]) -> Iterator[tuple]:
        filled = sum(len(p[3]) for p in pieces)
        # A window at a power of two is not padded; any other counts as one of the largest size.
        tier = filled if filled & (filled - 1) == 0 else self.tiers[-1]
        count = self.windows.get(tier, 0)
        self.windows[tier] = count + 1
        step = self.first_id + (count // max(1, self.step_tokens // tier)) * 64 + tier.bit_length()
        offset = 0
        for doc, total, start, ids in pieces:
            yield doc, total, start, len(ids), self.next_id, offset, tier, step, ids.astype("<u4").tobytes()
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        largest, start = self.tiers[-1], 0
        while len(ids) - start >= largest:
            yield from self._window([(doc, len(ids), start, ids[start:start + largest])])
            start += largest
        if start < len(ids):
            self._store(doc, len(ids), start, ids[start:])
        if len(self.pool) >= GATHERED:
            yield from self.fill(KEPT_BACK)

    def fill(self, keep: int = 0) -> Iterator[tuple]:
        """Fill windows until ``keep`` rests are left; with 0 all tokens are placed."""
        while len(self.pool) > keep:
            pieces = [self._take(len(self.pool) - 1)]
            gap = next(t for t in self.tiers if t >= len(pieces[0][3])) - len(pieces[0][3])
            while gap and self.pool:
                at = bisect_right(self.pool, (gap, self.serial)) - 1
                if at >= 0:
                    pieces.append(self._take(at))
                else:
                    # The shortest rest is longer than the gap: its head fills it, its tail waits on.
                    doc, total, start, ids = self._take(0)
                    pieces.append((doc, total, start, ids[:gap]))
                    self._store(doc, total, start + gap, ids[gap:])
                gap -= len(pieces[-1][3])
            if gap == 0:
                yield from self._window(pieces)
            else:
                yield from self._powers(pieces)

    def _powers(self, pieces: list[tuple]) -> Iterator[tuple]:
        left = sum(len(p[3]) for p in pieces)
        queue = list(reversed(pieces))
        while left:
            size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                doc, total, start, ids = queue.pop()
                window.append((doc, total, start, ids[:room]))
                if len(ids) > room:
                    queue.append((doc, total, start + room, ids[room:]))
                room -= len(window[-1][3])
            yield from self._window(window)
            left -= size


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS,
         step_tokens: int = STEP_TOKENS, vocabulary: str | None = None, end_id: int = END) -> DataFrame:
    """One row per piece: where it comes from, where it lies, and its ids as little-endian unsigned 32-bit integers.

    Every scan task tokenizes and packs its own documents in one pass: no shuffle, so no source or
    length can make a hot task, and a lost task is simply done again. ``tier`` is the window's size,
    ``step_id`` the step group, whose windows have one size and together ``step_tokens`` tokens
    (the last group of a task and size may have fewer).

    A missing or empty text is one end token. Rows that repeat an id are documents of their own;
    ids may be missing. An empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers are ascending powers of two")
    content = shipped(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = SCHEMA.format(kind=rows.schema["doc_id"].dataType.simpleString())
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]

    def run(batches):
        encoder = Encoder(content.value)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 40)

        def frame(pieces, kind):
            columns = list(zip(*pieces)) if pieces else [()] * len(names)
            kinds = [kind, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                pieces = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    pieces.extend(packer.add(doc, np.append(ids, np.uint32(end_id))))
                yield frame(pieces, kind)
        if kind is not None:
            rest = list(packer.fill())
            yield frame(rest, kind)

    return rows.mapInArrow(run, schema)
