"""Exact token ids of whole texts by a public tokenizer, with a cache of the pieces that texts repeat."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Pieces kept per task before the cache starts anew; it takes about fifty bytes for each.
CACHE = 1 << 20
# Unknown pieces that are encoded as one text, and bytes of text whose pieces are looked up at once.
GROUP, WINDOW = 512, 1 << 18
SPACE = 32
# Odd multipliers of the two keys of a piece and their inverses modulo 2**64.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(f, -1, 1 << 64) for f in FACTORS)


def table(*codes: int) -> np.ndarray:
    """Which of the 256 bytes are listed."""
    listed = np.zeros(256, bool)
    listed[list(codes)] = True
    return listed


BLANK = table(*range(9, 14), *range(28, 33))
MARK = table(*b".,;:!?")
LETTER = table(*range(65, 91), *range(97, 123))
# First bytes of the characters beyond ASCII that may be white space.
MAYBE_BLANK = table(0xC2, 0xE1, 0xE2, 0xE3)


def default_vocabulary() -> str:
    """Place of the public byte-level vocabulary; any other file of the library may be named instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shipped(spark: SparkSession, vocabulary: str | None):
    """The vocabulary file's content, sent to the executors once; its size does not depend on the data."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of consecutive runs: each of ``sizes`` places from its start on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places where UTF-8 texts, whose ends are ``edges``, may be cut without changing a token.

    The pattern of the byte-level vocabulary always parts before a single space between characters
    that are not white space, and between a letter and a mark behind it. Where the bytes leave any
    doubt, in rare scripts, there is no cut; each text begins with one.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    spaces = np.flatnonzero(data == SPACE)
    spaces = spaces[~edge[spaces] & ~edge[spaces + 1]]
    before, after = data[spaces - 1], data[spaces + 1]
    lead, lead3 = data[spaces - 2], data[spaces - 3]
    # A character of two bytes begins with 0xC3 to 0xDF unless it may be blank; longer ones begin further left.
    known = np.where(lead >= 0xC0, lead != 0xC2, ~MAYBE_BLANK[lead3])
    fit = ~BLANK[before] & ((before < 0x80) | known) & ~BLANK[after] & ~MAYBE_BLANK[after]
    marks = np.flatnonzero(MARK[data])
    marks = marks[~edge[marks]]
    before = data[marks - 1]
    accented = (data[marks - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    return np.sort(np.concatenate([edges[:-1][edges[:-1] < edges[1:]], spaces[fit], marks[LETTER[before] | accented]]))


def worker_encoder(content: str) -> Encoder:
    """The encoder of this Python worker, which serves the worker's tasks one after the other.

    It hangs on the library's module, the one thing that lives as long as the worker.
    """
    import tokenizers

    kept = getattr(tokenizers, "_kept_encoder", None)
    if kept is None or kept.content != content:
        kept = tokenizers._kept_encoder = Encoder(content)
    return kept


class Encoder:
    """Ids of texts, equal to the library's own for the whole text.

    Texts are cut into pieces (see ``cuts``) that are encoded once each. A piece is known by two
    64-bit keys, polynomials of its bytes; should one agree and the other not, the texts at hand
    are encoded whole. Unknown pieces that begin with a space are joined, encoded together, and told
    apart by the bytes of their tokens.
    """

    def __init__(self, content: str):
        # Spark already runs a task per core; the library's own threads would only add memory to each worker.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.content = content
        self.tokenizer = Tokenizer.from_str(content)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        # The byte-level alphabet has one character per byte.
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.powers = [np.ones(1, np.uint64)] * 4
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.slots, self.starts, self.lengths = (np.empty(0, np.int64) for _ in range(3))
        self.flat = np.empty(0, np.uint16)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Both keys of each piece: polynomials of its bytes, from running sums over all bytes."""
        if len(self.powers[0]) <= len(data):
            for i, factor in enumerate((*FACTORS, *INVERSES)):
                steps = np.full(len(data) + 1, factor, np.uint64)
                steps[0] = 1
                self.powers[i] = np.cumprod(steps)
        wide, out = data.astype(np.uint64) + np.uint64(1), []
        for up, down in zip(self.powers[:2], self.powers[2:]):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(wide * up[:len(data)], out=total[1:])
            out.append((total[ends] - total[starts]) * down[starts])
        return out

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        spaced = [i for i, piece in enumerate(pieces) if piece[0] == SPACE]
        single = [i for i, piece in enumerate(pieces) if piece[0] != SPACE]
        groups = [spaced[at:at + GROUP] for at in range(0, len(spaced), GROUP)] + [[i] for i in single]
        texts = [b"".join([pieces[i] for i in group]).decode() for group in groups]
        ids, counts = [], np.zeros(len(pieces), np.int64)
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            part = np.array(got.ids, np.int64)
            if len(group) == 1:
                counts[group[0]] = len(part)
            else:
                ends = np.cumsum([len(pieces[i]) for i in group])
                counts[group] = np.bincount(np.searchsorted(ends, np.cumsum(self.bytes[part]), "left"), minlength=len(group))
            ids.append(part)
        # Back from groups to the order of the pieces.
        order = np.array(spaced + single, np.int64)
        begins = np.empty(len(pieces), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(ids)[ranges(begins, counts)], counts

    def _window(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of consecutive pieces in a row, and how many each has; none if two keys are at odds."""
        key, check = self._hashes(data, starts, ends)
        distinct, first, at = np.unique(key, return_index=True, return_inverse=True)
        if (check != check[first][at]).any():
            return None
        if len(self.keys) > CACHE:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        if (self.checks[place[known]] != check[first[known]]).any():
            return None
        slot = np.empty(len(distinct), np.int64)
        slot[known] = self.slots[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw, f = data.tobytes(), first[new]
            ids, counts = self._learn([raw[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist())])
            slot[new] = len(self.lengths) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32)])
            self.keys, self.checks, self.slots = (np.insert(old, place[new], values) for old, values in (
                (self.keys, distinct[new]), (self.checks, check[f]), (self.slots, slot[new])))
        chosen = slot[at]
        sizes = self.lengths[chosen]
        return self.flat[ranges(self.starts[chosen], sizes)], sizes

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Token ids of each text as unsigned 32-bit integers; a missing text counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.cast(pa.large_string()).fill_null("")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if edges[0] == edges[-1]:
            return [np.empty(0, np.uint32)] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        starts = cuts(data, edges)
        ends = np.append(starts[1:], len(data))
        ids, sizes, at = [], [], 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, "right")))
            low = starts[at]
            got = self._window(data[low:ends[upto - 1]], starts[at:upto] - low, ends[at:upto] - low)
            if got is None:
                whole = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
                return [np.array(one.ids, np.uint32) for one in whole]
            ids.append(got[0].astype(np.uint32))
            sizes.append(got[1])
            at = upto
        flat, counts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        bounds = counts[np.searchsorted(starts, edges)]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]
