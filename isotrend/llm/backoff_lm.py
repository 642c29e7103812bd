"""Word n-gram language model as a weighted automaton with failure arcs, learnt from and applied to a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import id_remainder, whole_text

PARTS, HELD_OUT = 5, 1
# Words of an n-gram; histories have one less.
ORDER = 3
# Words of evidence that the next shorter history is worth against what was seen after one of one, two … words.
STRENGTHS = (1000.0, 1000.0)
ADDED = 0.5
# Text of one block of documents, whose n-grams are asked for together, in bytes, and most shards that answer.
BLOCK_BYTES, SHARDS = 8 << 20, 1 << 16
# Bits of the hashes of pairs and longer n-grams that are left out: 56 stay, under which a million million n-grams
# share a key with a chance of 1e-5 each.
DROPPED = 8
# Tokens that one stretch of a traversal takes; a longer text is taken up again with the state its words give.
STRETCH = 512
# No word contains white space, so these stand for the end and the start of a text.
END, START = b"\n", b" "


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit key per ordered pair of word hashes."""
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def deflate(numbers: np.ndarray) -> bytes:
    """Unsigned integers, their bytes by place and compressed: leading zeros cost next to nothing."""
    wide = np.ascontiguousarray(numbers)
    planes = wide.view(np.uint8).reshape(-1, wide.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def inflate(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which take fewer bytes."""
    return np.diff(keys, prepend=np.uint64(0))


@dataclass
class Tokens:
    """The tokens of a block of documents, words and then one end each, and the distinct n-grams that end at them.

    Lists have one entry per order, from single words on. The first token follows the start alone, so the longest
    n-gram there is a pair; ``at`` is -1 where a token ends none.
    """

    sizes: np.ndarray       # tokens per document
    keys: list[np.ndarray]  # distinct hashes, ascending
    at: list[np.ndarray]    # per token, the place of its n-gram
    head: list[np.ndarray]  # per n-gram, the place of all but its last word among the shorter ones, -1 for the start
    tail: list[np.ndarray]  # and of all but its first

    @staticmethod
    def of(texts: list[bytes], order: int = ORDER) -> Tokens:
        known: dict[bytes, int] = {END: word_hash(END)}
        hashes, sizes = [], []
        for text in texts:
            # bytes.lower() changes A-Z alone and bytes.split() cuts at the six ASCII white-space characters.
            words = text.lower().split()
            words.append(END)
            for word in words:
                if word not in known:
                    known[word] = word_hash(word)
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
        current, sizes = np.concatenate(hashes), np.array(sizes, np.int64)
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(len(current)) - np.repeat(firsts, sizes)
        grams, at = np.unique(current, return_inverse=True)
        none = np.full(len(grams), -1, np.int32)
        out = Tokens(sizes, [grams], [at.astype(np.int32)], [none], [none])
        longer = current
        for n in range(2, order + 1):
            before = np.empty_like(longer)
            before[1:] = longer[:-1]
            if n == 2:
                before[firsts] = np.uint64(word_hash(START))
            longer = pair_hash(before, current)
            there = np.flatnonzero(place >= n - 2)
            # What travels of a longer n-gram is the first 56 bits of its hash.
            grams, first, found = np.unique(longer[there] >> np.uint64(DROPPED), return_index=True, return_inverse=True)
            at = np.full(len(current), -1, np.int32)
            at[there] = found
            where = there[first]
            out.keys.append(grams)
            out.head.append(np.where(place[where] > 0, out.at[-1][where - 1], -1).astype(np.int32))
            out.tail.append(out.at[-1][where])
            out.at.append(at)
        return out

    def counts(self, learnt: np.ndarray) -> list[np.ndarray]:
        """How often each distinct n-gram occurs in the documents to learn from."""
        weight = np.repeat(learnt, self.sizes).astype(np.float64)
        return [np.bincount(at[at >= 0], weight[at >= 0], len(keys)).astype(np.uint64) for at, keys in zip(self.at, self.keys)]


class Automaton:
    """The part of a backoff automaton that a block of documents can reach.

    A state is a history that was seen: none, the start, or up to order - 1 words. It has an arc for every word
    seen after it, which leads to the longest history that the word leaves, and a failure arc to the history
    without its first word, from which the word is tried again. The empty history has an arc for every word.
    With p(x) = (c(x) + 0.5) / (N + 0.5 (V + 1)) and, for a history h and h' without its first word,

        p(x | h) = (c(hx) + s p(x | h')) / (c(h) + s)        on the arc of x, as log10
        s / (c(h) + s)                                        on the failure arc

    the probabilities after any history add up to one, unknown words counting as one word.
    """

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], total: int, distinct: int, ends: int,
                 strengths: Sequence[float] = STRENGTHS):
        order, words = len(counts), len(tokens.keys[0])
        end = np.searchsorted(tokens.keys[0], np.uint64(word_hash(END)))
        self.base = (counts[0] + ADDED) / (total + ADDED * (distinct + 1))
        # States: the empty history, the start, then those n-grams that may go on, order by order.
        self.empty, self.start = 0, 1 if ends else 0
        state_of, states = [], 2
        last = np.arange(words, dtype=np.int32)
        for n in range(1, order):
            last = last if n == 1 else last[tokens.tail[n - 1]]
            seen = (counts[n - 1] > 0) & (last != end)
            numbers = np.full(len(seen), -1, np.int32)
            numbers[seen] = states + np.arange(seen.sum())
            states += int(seen.sum())
            state_of.append(numbers)
        self.level = np.zeros(states, np.int8)
        self.failure, self.failure_weight = np.zeros(states, np.int32), np.zeros(states)
        self.level[1] = 1
        self.failure_weight[1] = np.log10(strengths[0] / (ends + strengths[0])) if order > 1 else 0
        for n, numbers in enumerate(state_of, 1):
            seen = numbers >= 0
            self.level[numbers[seen]] = n
            self.failure_weight[numbers[seen]] = np.log10(strengths[n - 1] / (counts[n - 1][seen] + strengths[n - 1]))
            if n > 1:
                self.failure[numbers[seen]] = state_of[n - 2][tokens.tail[n - 1][seen]]
        # Arcs, by the n-gram they complete: where they lead, -1 if there is none, and their weights.
        chance = self.base
        self.target = [np.maximum(state_of[0], 0) if state_of else np.zeros(words, np.int32)]
        self.weight = [np.log10(chance)]
        for n in range(2, order + 1):
            head, tail, s = tokens.head[n - 1], tokens.tail[n - 1], strengths[n - 2]
            before = np.where(head >= 0, counts[n - 2][head], ends)
            chance = (counts[n - 1] + s * chance[tail]) / (before + s)
            longest = np.maximum(state_of[n - 1] if n < order else state_of[n - 2][tail], 0)
            self.target.append(np.where(counts[n - 1] > 0, longest, -1))
            self.weight.append(np.log10(chance))

    def step(self, state: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 weights of one word each, given as the n-grams it completes behind each history.

        A state of some words has an arc if the n-gram one longer was seen; else its failure arc leads to one word
        less, down to the empty history, which has every arc.
        """
        state, gained = state.copy(), np.zeros(len(state))
        open_ = np.ones(len(state), bool)
        for n in range(len(grams) - 1, -1, -1):
            at = np.flatnonzero(open_ & (self.level[state] == n))
            if not len(at):
                continue
            gram = grams[n][at]
            target = self.target[n][gram]
            hit, miss = at[target >= 0], at[target < 0]
            gained[hit] += self.weight[n][gram[target >= 0]]
            state[hit] = target[target >= 0]
            open_[hit] = False
            gained[miss] += self.failure_weight[state[miss]]
            state[miss] = self.failure[state[miss]]
        return state, gained

    def traverse(self, tokens: Tokens, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each document from left to right, all side by side, each carrying its state.

        A state depends on order - 1 words alone, so a long document goes on in stretches that begin
        that many words early, without weight, to come to the state at which they take over.
        """
        order = len(tokens.keys)
        firsts = np.cumsum(tokens.sizes) - tokens.sizes
        parts = -(-tokens.sizes // stretch)
        document = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(document)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = firsts[document] + number * stretch
        size = np.minimum(tokens.sizes[document] - number * stretch, stretch)
        early = np.minimum(order - 1, number * stretch)
        state = np.where(early == number * stretch, self.start, self.empty)
        longest = np.argsort(-(size + early), kind="stable")
        begin, size, early, document, state = (of[longest] for of in (begin, size, early, document, state))
        gained = np.zeros(len(size))
        length = size + early
        for t in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length, -t, "left"))
            here = begin[:alive] - early[:alive] + t
            state[:alive], weight = self.step(state[:alive], [at[here] for at in tokens.at])
            gained[:alive] += np.where(t >= early[:alive], weight, 0)
        return np.bincount(document, gained, len(parts))


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", strengths: Sequence[float] = STRENGTHS,
           order: int = ORDER, block_bytes: int = BLOCK_BYTES, shards: int = SHARDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per input row.

    The model is never in one place: it grows with the corpus, and so does what is shuffled.

    1. Documents are dealt into blocks. A block sends its distinct n-grams, up to ``order`` words, with their
       training counts to shards by hash range, as one packed row per shard.
    2. A shard adds up the counts of all blocks and answers each block in the order of its keys.
    3. The block builds the part of the automaton that its own texts can reach and traverses it.

    Keys are spread by hash, so no frequent word makes a hot shard, and one block asks for an n-gram
    once. There are as many shards as blocks up to ``shards``, so the packed rows grow with the corpus. Blocks follow
    the id and the place of the row in the input, so equal rows are dealt over all blocks. Both uses of the blocks read
    one shuffle. A missing text is empty: its one token is the end. Rows that repeat an id are documents of their own.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (id_remainder(doc_id, PARTS) == HELD_OUT).alias("held_out"),
                       whole_text(text).cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    shards = min(blocks, shards)
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    counts_of = [f"counts{n}" for n in range(1, order + 1)]
    names = [name for n in range(1, order + 1) for name in (f"keys{n}", f"counts{n}")]
    # Shard s holds the keys in its even share of the range of 64 bits.
    edges = np.array([-(-(s << 64) // shards) for s in range(1, shards)], np.uint64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [zstandard.compress(body.as_py(), 1) for body in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bodies, pa.binary()), batch.column(3)], batch.schema.names)

    def tokens_of(table: pa.Table) -> Tokens:
        return Tokens.of([zstandard.decompress(body.as_py()) for body in table.column("body")], order)

    def ask(table: pa.Table) -> pa.Table:
        tokens = tokens_of(table)
        learnt = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        out = {"shard": list(range(shards)), "block": [table.column("block")[0].as_py()] * shards}
        for n, (keys, counts) in enumerate(zip(tokens.keys, tokens.counts(learnt)), 1):
            cut = [0, *np.searchsorted(keys, edges if n == 1 else edges >> np.uint64(DROPPED)), len(keys)]
            out[f"keys{n}"] = [deflate(gaps(keys[a:b])) for a, b in zip(cut, cut[1:])]
            out[f"counts{n}"] = [deflate(counts[a:b]) for a, b in zip(cut, cut[1:])]
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in names]]))

    def add_up(table: pa.Table) -> pa.Table:
        out = {"block": table.column("block").to_pylist(), "shard": table.column("shard").to_pylist()}
        for n in range(1, order + 1):
            keys = [np.cumsum(inflate(x, np.uint64), dtype=np.uint64) for x in table.column(f"keys{n}").to_pylist()]
            counts = [inflate(x, np.uint64) for x in table.column(f"counts{n}").to_pylist()]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts).astype(np.float64)).astype(np.uint64)
            ends = np.cumsum([0, *map(len, keys)])
            out[f"counts{n}"] = [deflate(total[at[a:b]]) for a, b in zip(ends, ends[1:])]
            if n == 1:
                out["total"] = [int(total.sum())] * len(keys)
                out["distinct"] = [int((total > 0).sum())] * len(keys)
        return pa.table(out, schema=pa.schema([("block", pa.int32()), ("shard", pa.int32()), *[(c, pa.binary()) for c in counts_of],
                                               ("total", pa.int64()), ("distinct", pa.int64())]))

    def answer(table: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("shard")
        total, distinct = (sum(replies.column(c).to_pylist()) for c in ("total", "distinct"))
        counts = [np.concatenate([inflate(x, np.uint64) for x in replies.column(c).to_pylist()]).astype(np.float64) for c in counts_of]
        tokens = tokens_of(table)
        ends = counts[0][np.searchsorted(tokens.keys[0], np.uint64(word_hash(END)))]
        automaton = Automaton(tokens, counts, total, distinct, ends, strengths)
        firsts = np.cumsum(tokens.sizes) - tokens.sizes
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(tokens.sizes),
            "n_known": pa.array(np.add.reduceat((counts[0] > 0)[tokens.at[0]].astype(np.int64), firsts)),
            "train_tokens": pa.array(np.full(len(tokens.sizes), total, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(automaton.base)[tokens.at[0]], firsts)),
            "score": pa.array(automaton.traverse(tokens))})

    dealt = numbered.mapInArrow(pack, f"doc_id {kind}, held_out boolean, body binary, block int")
    asked = dealt.groupBy("block").applyInArrow(ask, "shard int, block int, " + ", ".join(f"{c} binary" for c in names))
    replied = asked.groupBy("shard").applyInArrow(add_up, "block int, shard int, " + ", ".join(
        f"{c} binary" for c in counts_of) + ", total long, distinct long")
    return dealt.groupBy("block").cogroup(replied.groupBy("block")).applyInArrow(
        answer, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")
