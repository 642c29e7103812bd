"""Cheapest edits that give each conversation a proper order of roles, by a checkpointed dynamic program.

Costs to go are computed backward and kept only at checkpoints; going forward, each block between two of
them is computed once more and its edits are read off. The same holds one level up: a conversation that
spreads over many tasks is cut into fragments, whose cost matrices give the vectors at their borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import written

# Costs of the edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, STAYS = 4, 3, 3, 3
# Turns and bytes of text at which a chunk ends.
CHUNK_TURNS, CHUNK_BYTES = 1024, 1 << 16
# Roles by their initial; 0 is any other. A conversation is nothing, or pairs of user and assistant, a system turn before them.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
# States: nothing yet, then the kind of the last turn. What an inserted or changed turn leads to from each.
NOTHING, NEXT = 0, (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# Costs to go from each state behind the last turn.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
# A turn is a code: its kind, 4 more if truncated, 8 more if it must go.
TRUNCATED, MUST_GO = 4, 8


class Move(NamedTuple):
    letter: str
    cost: int
    to: int


def moves_of(code: int) -> list[list[Move]]:
    """What may be done with a turn in each state, in order of the letters."""
    kind, extra = code % 4, STAYS if code & TRUNCATED else 0
    out = []
    for state in range(4):
        moves = [Move("D", DELETE, state)]
        if not code & MUST_GO:
            if kind == NEXT[state] or (kind == SYSTEM and state == NOTHING):
                moves.append(Move("K", extra, kind))
            moves.append(Move("R", REROLE + extra, NEXT[state]))
        out.append(moves)
    return out


MOVES = [moves_of(code) for code in range(16)]


def before(code: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go ahead of a turn from those behind it; turns may be inserted ahead of it."""
    none, system, user, assistant = (min(m.cost + behind[m.to] for m in moves) for moves in MOVES[code])
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(none, INSERT + user), min(system, INSERT + user), user, assistant


def matrix(codes: bytes) -> list[int]:
    """Cheapest way through a fragment from each state, by rows, to each state behind it."""
    columns = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]
    for code in reversed(codes):
        columns = [before(code, column) for column in columns]
    return [min(columns[t][s], FAR) for s in range(4) for t in range(4)]


def through(flat: list[int], behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go ahead of a fragment from those behind it."""
    return tuple(min(flat[4 * s + t] + behind[t] for t in range(4)) for s in range(4))


def checkpoints(codes: bytes, behind: tuple[int, ...], size: int) -> tuple[dict[int, tuple[int, ...]], tuple[int, ...]]:
    """Costs to go ahead of every ``size``-th turn and behind the last, and those ahead of the first."""
    kept = {len(codes): behind}
    for i in range(len(codes) - 1, -1, -1):
        behind = before(codes[i], behind)
        if i % size == 0:
            kept[i] = behind
    return kept, behind


def walk(codes: bytes, behind: tuple[int, ...], state: int, last: bool,
         kept: dict[int, tuple[int, ...]] | None = None) -> tuple[str, int]:
    """The least letters, in ASCII order, of the cheapest edits from ``state`` on, and the state they end in.

    Memory is about the root of the number of turns, beside the turns and letters. Only the ``last`` fragment
    inserts behind its last turn; ahead of another fragment that is for the next one.
    """
    size = max(1, isqrt(len(codes)))
    kept = kept or checkpoints(codes, behind, size)[0]
    letters = []
    for at in range(0, len(codes), size):
        upto = min(at + size, len(codes))
        block = [kept[upto]]
        for i in range(upto - 1, at - 1, -1):
            block.append(before(codes[i], block[-1]))
        block.reverse()
        for i in range(at, upto):
            ahead, behind = block[i - at], block[i - at + 1]
            moves = MOVES[codes[i]]
            while True:
                tight = [m for m in moves[state] if m.cost + behind[m.to] == ahead[state]]
                if INSERT + ahead[NEXT[state]] == ahead[state] and not (tight and tight[0].letter == "D"):
                    letters.append("I")
                    state = NEXT[state]
                    continue
                letters.append(tight[0].letter)
                state = tight[0].to
                break
    while last and END[state]:
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def replay(turns: list[tuple[int, str, str]], letters: str, state: int) -> list[dict[str, str]]:
    """The repaired turns of a fragment from its (kind, role, text), the edits and the state they start in."""
    out, at = [], 0
    for letter in letters:
        kind, role, text = turns[at] if letter != "I" else (None, None, "")
        if letter != "I":
            at += 1
        if letter == "D":
            continue
        state = kind if letter == "K" else NEXT[state]
        out.append({"role": role if letter == "K" else NAMES[state], "text": text})
    return out


def kind_of(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)


def _chunks(turns: DataFrame, conv_type: str) -> DataFrame:
    """All turns in order, cut into chunks of bounded size whatever the conversation, and written.

    Tasks get ranges of conversation, turn and further keys, so a conversation of any length spreads over
    many. ``chunk, pos`` is the place of a turn in the order of all.
    """
    keys = ["conv", "turn", "role", "tie", "scan"]
    ordered = turns.withColumns({"tie": F.xxhash64("text"), "scan": F.spark_partition_id()})
    ordered = ordered.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]) \
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).select("conv", "turn", "role", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, pos, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            chunks, places = [], []
            for size in pc.binary_length(batch.column(3)).to_pylist():
                if pos and (pos >= CHUNK_TURNS or held + size > CHUNK_BYTES):
                    chunk, pos, held = chunk + 1, 0, 0
                chunks.append(chunk)
                places.append(pos)
                pos, held = pos + 1, held + size
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(places, pa.int32()), *batch.columns],
                                             ["chunk", "pos", "conv", "turn", "role", "text"])

    return written(ordered.mapInArrow(cut, f"chunk long, pos int, conv {conv_type}, turn long, role string, text string"),
                   "conversation-turns")


FRAGMENT = ("n long, blank long, duplicate long, truncated long, illegal long, head int, tail int, low long, high long, turns long, "
            "codes binary, edge boolean, matrix array<long>")


def _fragments(chunks: DataFrame, conv_type: str) -> DataFrame:
    """One row for the turns of each conversation in each chunk: counts, codes and, where it may go on elsewhere, costs.

    The first of equal turns is found by an aggregate that combines before it shuffles, and meets the others by chunk.
    """
    ended = F.rtrim("text", F.lit("\t\n\x0b\x0c\r "))
    light = chunks.select("chunk", "pos", "conv", "turn", kind_of(F.col("role")).alias("kind"), (ended == "").alias("empty"),
                          (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("cut"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = chunks.groupBy("conv", F.unhex(key).alias("key")).agg(F.min(F.struct("chunk", "pos")).alias("first"))

    def gather(turns: pa.Table, firsts: pa.Table) -> pa.Table:
        turns = turns.sort_by("pos")
        new = set(firsts.column("pos").to_pylist())
        column = {name: turns.column(name).to_pylist() for name in turns.column_names}
        n = turns.num_rows
        starts = [i for i in range(n) if i == 0 or column["conv"][i] != column["conv"][i - 1]]
        out = []
        for a, b in zip(starts, [*starts[1:], n]):
            rows = range(a, b)
            blank = [column["empty"][i] for i in rows]
            again = [not e and column["pos"][i] not in new for i, e in zip(rows, blank)]
            cut = [c and not e and not d for c, e, d in zip(column["cut"][a:b], blank, again)]
            kinds, times = column["kind"][a:b], [t for t in column["turn"][a:b] if t is not None]
            codes = bytes(k + TRUNCATED * c + MUST_GO * (e or d) for k, c, e, d in zip(kinds, cut, blank, again))
            edge = a == 0 or b == n
            out.append({"chunk": column["chunk"][a], "pos": column["pos"][a], "conv": column["conv"][a], "n": b - a,
                        "blank": sum(blank), "duplicate": sum(again), "truncated": sum(cut),
                        "illegal": sum(p not in LEGAL for p in pairwise(kinds)), "head": kinds[0], "tail": kinds[-1],
                        "low": min(times, default=None), "high": max(times, default=None), "turns": len(set(times)),
                        "codes": codes, "edge": edge, "matrix": matrix(codes) if edge else None})
        types = {"chunk": pa.int64(), "pos": pa.int32(), "conv": turns.schema.field("conv").type, "head": pa.int32(), "tail": pa.int32(),
                 "codes": pa.binary(), "edge": pa.bool_(), "matrix": pa.list_(pa.int64())}
        schema = pa.schema([(name, types.get(name, pa.int64())) for name in out[0]]) if out else None
        return pa.Table.from_pylist(out, schema) if out else turns.slice(0, 0)

    found = light.groupBy("chunk").cogroup(first.select("first.*").groupBy("chunk")).applyInArrow(
        gather, f"chunk long, pos int, conv {conv_type}, {FRAGMENT}")
    return written(found, "conversation-fragments")


def _borders(fragments: DataFrame) -> DataFrame:
    """For fragments at the edge of their chunk, the costs to go behind them and what they share with the one ahead.

    One row per conversation holds its fragments' figures, not its turns.
    """
    listed = fragments.filter("edge").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(
        "chunk", "pos", "matrix", "head", "tail", "low", "high"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(0).to_pylist():
                behind, rows = END, []
                for at in range(len(parts) - 1, -1, -1):
                    part = parts[at]
                    rows.append({"chunk": part["chunk"], "pos": part["pos"], "behind": list(behind), "opens": at == 0,
                                 "closes": at == len(parts) - 1, "clash": 0, "shared": 0})
                    behind = through(part["matrix"], behind)
                top = None
                for part, row in zip(parts, reversed(rows)):
                    if not row["opens"]:
                        row["clash"] = int((previous, part["head"]) not in LEGAL)
                        row["shared"] = int(top is not None and part["low"] == top)
                    previous, top = part["tail"], top if part["high"] is None else part["high"]
                out += rows
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("chunk", pa.int64()), ("pos", pa.int32()), ("behind", pa.list_(pa.int64())), ("opens", pa.bool_()),
                ("closes", pa.bool_()), ("clash", pa.int64()), ("shared", pa.int64())]))

    return listed.select("parts").mapInArrow(
        run, "chunk long, pos int, behind array<long>, opens boolean, closes boolean, clash long, shared long")


def _edits(fragments: DataFrame, conv_type: str) -> DataFrame:
    """The edits of each fragment: ``letters`` from the state in which it ``starts``.

    Fragments are walked where they are, from every state they may start in; which one it is follows from
    the ends of those ahead, a few numbers per fragment.
    """
    counts = ["n", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
    joined = fragments.drop("matrix", "head", "tail", "edge").join(_borders(fragments), ["chunk", "pos"], "left").select(
        "chunk", "pos", "conv", "codes", "behind", F.coalesce("opens", F.lit(True)).alias("opens"),
        F.coalesce("closes", F.lit(True)).alias("closes"), *[c for c in counts if c not in ("illegal", "turns")],
        (F.col("illegal") + F.coalesce("clash", F.lit(0))).alias("illegal"),
        (F.col("turns") - F.coalesce("shared", F.lit(0))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, ends, walks = [], [], []
            for codes, behind, opens, closes in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
                behind = tuple(behind) if behind else END
                kept, ahead = checkpoints(codes, behind, max(1, isqrt(len(codes))))
                done = [walk(codes, behind, s, closes, kept) for s in ((NOTHING,) if opens else range(4))]
                walks.append([letters for letters, _ in done])
                ends.append([end for _, end in done])
                costs.append(ahead[NOTHING] if opens else 0)
            arrays = [*batch.columns, pa.array(costs, pa.int64()), pa.array(ends, pa.list_(pa.int64())),
                      pa.array(walks, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "cost", "ends", "walks"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields)
    walked = written(joined.mapInArrow(run, f"{fields}, cost long, ends array<long>, walks array<string>"), "conversation-edits")

    chains = walked.filter("not (opens and closes)").groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "pos", "ends"))).alias("parts"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(0).to_pylist():
                state = NOTHING
                for part in parts:
                    out.append({"chunk": part["chunk"], "pos": part["pos"], "starts": state})
                    # The first fragment has one end, that from the state of nothing.
                    state = part["ends"][state]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("pos", pa.int32()), ("starts", pa.int32())]))

    starts = chains.select("parts").mapInArrow(chain, "chunk long, pos int, starts int")
    state = F.coalesce("starts", F.lit(NOTHING))
    return walked.join(starts, ["chunk", "pos"], "left").select(
        "chunk", "pos", "conv", *counts, "cost", state.alias("starts"), F.get("walks", state).alias("letters"))


class Repair(NamedTuple):
    """``summary``: one row per conversation; ``pieces``: its repaired turns, in order of ``chunk``."""

    summary: DataFrame
    pieces: DataFrame


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Find the faults of every conversation and the cheapest edits that mend it.

    Turns go by ``turn``, missing ones first; of equal ones by role, then by a hash of the text, which keeps
    repeated rows together. A missing role or text is one space. The first fault of a turn counts: ``blank``,
    ``duplicate`` (role and text seen earlier in the conversation), ``truncated`` (its last character that
    is not white space is none of ``.!?``). ``audit`` has the edits' initials (Keep, Rerole, Delete, Insert), of
    equally cheap ones the least in ASCII order. Rows without conversation id are one conversation; an empty
    table gives no rows. The result has only these names, whatever else the table has.

    No task holds a conversation's turns: chunks of bounded size are the unit of work. What comes together per
    conversation is a row of figures per chunk of it and, in the result, its ``audit`` of one letter per edit.
    """
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    conv_type = rows.schema["conv"].dataType.simpleString()
    chunks = _chunks(rows, conv_type)
    edits = _edits(_fragments(chunks, conv_type), conv_type)

    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "pos", "letters"))), lambda p: p["letters"]), "")
    sums = [F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long")
    summary = edits.groupBy("conv").agg(*sums, gaps.alias("gaps"), letters.alias("audit")).select(
        F.col("conv").alias("conv_id"), "n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def mend(found: pa.Table, plans: pa.Table) -> pa.Table:
        found = found.sort_by("pos")
        kinds, roles, texts = (found.column(c).to_pylist() for c in ("kind", "role", "text"))
        rows = list(zip(kinds, roles, texts))
        out = [replay(rows[p["pos"]:p["pos"] + p["n"]], p["letters"], p["starts"]) for p in plans.to_pylist()]
        return pa.table({"chunk": plans.column("chunk"), "conv_id": plans.column("conv"), "turns": pa.array(out, pa.list_(
            pa.struct([("role", pa.string()), ("text", pa.string())])))})

    texts = chunks.select("chunk", "pos", kind_of(F.col("role")).alias("kind"), "role", "text").groupBy("chunk")
    plans = edits.select("chunk", "pos", "conv", "n", "letters", "starts").groupBy("chunk")
    pieces = texts.cogroup(plans).applyInArrow(
        mend, f"chunk long, conv_id {conv_type}, turns array<struct<role: string, text: string>>")
    return Repair(summary, pieces)


def hashed(pieces: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the hash of each conversation's repaired ``role:text`` lines.

    A hash takes its input in order, so the pieces of a conversation stream through one task, and only the
    hash's state is held.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    body = pieces.filter(F.size("turns") > 0).select("conv_id", "chunk", lines.alias("lines"))
    ordered = body.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    conv_type = body.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, arrow = None, None, None
        for batch in batches:
            convs, hashes, arrow = [], [], batch.schema.field(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if state is not None and conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        convs.append(now)
                        hashes.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                state.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, arrow), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {conv_type}, repaired_sha256 string")
