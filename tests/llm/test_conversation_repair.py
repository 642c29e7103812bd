import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from isotrend.llm import conversation_repair as repairing
from isotrend.llm.queries import damaged_turns, op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, n long, chunk string, pos string"


def faults_of(turns):
    """Fault of each (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(turns):
    """Cost, letters and repaired turns by trying every choice per turn and every number of insertions between them."""
    faults, best = faults_of(turns), None
    options = [[("D", 4)] if f in ("blank", "duplicate") else
               [("D", 4), ("K", 3 * (f == "truncated")), ("R", 3 + 3 * (f == "truncated"))] for f in faults]
    for chosen in product(*options):
        base = sum(cost for _, cost in chosen)
        if best and base > best[0]:
            continue
        for gaps in product(range(3), repeat=len(turns) + 1):
            cost = base + 3 * sum(gaps)
            if best and cost > best[0]:
                continue
            letters = "".join("I" * g + c for g, (c, _) in zip(gaps, chosen)) + "I" * gaps[-1]
            rows = fitted(turns, letters)
            if rows is not None and (best is None or (cost, letters) < best[:2]):
                best = (cost, letters, rows)
    return best


def fitted(turns, letters):
    """The turns after the edits, with the roles that the pattern asks for, or nothing if they do not fit."""
    rows, at = [], 0
    for letter in letters:
        turn = turns[at] if letter != "I" else None
        at += letter != "I"
        if letter != "D":
            rows.append((letter, turn))
    out, want = [], "u"
    for i, (letter, turn) in enumerate(rows):
        if letter == "K":
            initial = turn[1][:1]
            if initial == "s" and i == 0:
                out.append((turn[1], turn[2]))
                continue
            if initial != want:
                return None
            out.append((turn[1], turn[2]))
        else:
            out.append(({"u": "user", "a": "assistant"}[want], turn[2] if letter == "R" else ""))
        want = "a" if want == "u" else "u"
    return out if want == "u" and not (len(out) == 1) else None


def expected(turns):
    """All columns of a conversation's answer, from its turns in order."""
    faults = faults_of(turns)
    times = [t for t, _, _ in turns if t is not None]
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, letters, rows = brute(turns) if turns else (0, "", [])
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, sha)


def conversations(seed, count, longest):
    draw, rows = random.Random(seed), []
    for conv in range(count):
        for turn in range(draw.randint(1, longest)):
            text = draw.choice(["Yes.", "No!", "cut off", "", " \t", "Why? ", f"t{turn}."])
            rows.append((conv, None if draw.random() < 0.1 else turn + draw.randint(0, 1),
                         draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), text))
    # One turn of a conversation per number, so that the order is given.
    return list({(r[0], r[1]): (*r, 7, "x", None) for r in rows}.values())


def in_order(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, role, text))
    return {c: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0)) for c, g in groups.items()}


def answers(spark, rows):
    done = repairing.repair(spark.createDataFrame(rows, SCHEMA))
    hashes = {r.conv_id: r.repaired_sha256 for r in repairing.hashed(done.pieces).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, none))
            for r in done.summary.collect()}


@pytest.mark.parametrize("turns", [1024, 2])
def test_like_all_edits(spark, monkeypatch, turns):
    """Also with chunks so small that conversations go over several."""
    monkeypatch.setattr(repairing, "CHUNK_TURNS", turns)
    rows = conversations(turns, 150, 5)
    assert answers(spark, rows) == {c: expected(t) for c, t in in_order(rows).items()}


def test_fragments_are_as_the_whole():
    draw = random.Random(2)
    for _ in range(300):
        codes = bytes(draw.choice([1, 2, 3, 2, 3, 0, 6, 7, 10, 11]) for _ in range(draw.randint(1, 60)))
        whole, state = repairing.walk(codes, repairing.END, 0, True)
        cuts = sorted({0, len(codes), *[draw.randrange(len(codes)) for _ in range(3)]})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        behind = [repairing.END]
        for part in reversed(parts[1:]):
            behind.append(repairing.through(repairing.matrix(part), behind[-1]))
            assert behind[-1] == repairing.checkpoints(part, behind[-2], 1)[1]
        letters, now = "", 0
        for i, (part, vector) in enumerate(zip(parts, reversed(behind))):
            more, now = repairing.walk(part, vector, now, i == len(parts) - 1)
            letters += more
        assert (letters, now) == (whole, state)


def test_few_vectors_are_kept():
    codes = bytes([2, 3, 6, 10] * 2500)
    assert len(repairing.checkpoints(codes, repairing.END, 100)[0]) == 101


def test_one_conversation_over_many_tasks(spark):
    """A conversation with most of all rows, in pieces, equals the walk over it as a whole."""
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i % 4000}" + "." * (i % 5 > 0), 0, "", "") for i in range(9000)]
    rows += [(c, 0, "user", "hello.", 0, "", "") for c in range(2, 40)]
    done = repairing.repair(spark.createDataFrame(rows, SCHEMA).repartition(8))
    pieces = done.pieces.filter("conv_id = 1").collect()
    assert len(pieces) > 5
    turns = [r[1:4] for r in rows[:9000]]
    codes = bytes({"user": 2, "assistant": 3}[role] + 4 * (fault == "truncated") + 8 * (fault in ("blank", "duplicate"))
                  for (_, role, _), fault in zip(turns, faults_of(turns)))
    got = {r.conv_id: r for r in done.summary.collect()}
    letters = repairing.walk(codes, repairing.END, 0, True)[0]
    assert got[1].audit == letters and got[1].n == 9000
    assert got[1].cost == repairing.checkpoints(codes, repairing.END, 1)[1][0]
    whole = repairing.replay([(c % 4, r, t) for c, (_, r, t) in zip(codes, turns)], letters, 0)
    assert [(t.role, t.text) for p in sorted(pieces, key=lambda p: p.chunk) for t in p.turns] == [(t["role"], t["text"]) for t in whole]
    hashes = {r.conv_id: r.repaired_sha256 for r in repairing.hashed(done.pieces).collect()}
    assert hashes[1] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in whole).encode()).hexdigest()


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def shown(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_on_conversations(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    groups = in_order(harmed(rows))
    short = {c for c in {r[0] for r in rows} if len(groups.get(c, [])) <= 6}
    got = shown(op13_conversation_repair(spark, small))
    assert set(got) == {r[0] for r in rows}
    assert {c: got[c] for c in short} == {c: expected(groups.get(c, [])) for c in short}


def test_odd(spark, tmp_path):
    rows = [(None, None, None, None), (1, None, "user", "Hi."), (1, 5, None, "x"), (2, 3, "user", None), (3, 1, "system", "Go."),
            (3, 2, "user", "a" * 300_000 + "."), (3, 3, "assistant", " "), (None, 4, "assistant", "Ok.")]
    rows += [(4, i, "user", "Same.") for i in range(5)] + [(c, 0, "user", "One.") for c in range(10, 60)]
    spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    groups = in_order(harmed(rows))
    assert shown(op13_conversation_repair(spark, str(tmp_path))) == {c: expected(groups.get(c, [])) for c in {r[0] for r in rows}}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = repairing.repair(damaged_turns(none))
    assert done.summary.collect() == [] and done.pieces.collect() == [] and repairing.hashed(done.pieces).collect() == []
