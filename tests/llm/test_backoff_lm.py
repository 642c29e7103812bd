import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from isotrend.llm import backoff_lm as lm


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w.decode()) for w in (text or "").encode().split()] + ["\n"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def brute(rows, strengths, order):
    """Every score from counts of the whole table, by the recursion over shorter and shorter histories."""
    counts, starts = [Counter() for _ in range(order + 1)], 0
    for r in rows:
        if not held(r[0]):
            t = tokens(r[1])
            starts += 1
            for i in range(len(t)):
                for n in range(1, order + 1):
                    if n == 1 or i >= n - 2:
                        counts[n][tuple([" ", *t][i + 2 - n:i + 2])] += 1
    n, v = sum(counts[1].values()), len(counts[1])

    def chance(history, x):
        if not history:
            return (counts[1][x,] + 0.5) / (n + 0.5 * (v + 1))
        seen = starts if history == (" ",) else counts[len(history)][history]
        s = strengths[len(history) - 1]
        return (counts[len(history) + 1][*history, x] + s * chance(history[1:] if history != (" ",) else (), x)) / (seen + s)

    out = []
    for r in rows:
        t = tokens(r[1])
        base = sum(log10(chance((), x)) for x in t)
        score = sum(log10(chance(tuple([" ", *t][max(0, i + 2 - order):i + 1]), x)) for i, x in enumerate(t))
        out.append((r[0], held(r[0]), len(t), sum(counts[1][x,] > 0 for x in t), n, base, score))
    return out


def check(df, rows, strengths=lm.STRENGTHS, order=lm.ORDER):
    order_by = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, df.collect()), key=order_by), sorted(brute(rows, strengths, order), key=order_by)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_documents(documents, rows):
    check(lm.scores(documents), rows)


def test_many_blocks(documents, rows):
    check(lm.scores(documents, block_bytes=20_000), rows)


def test_odd(odd, odd_rows, nothing, all_missing):
    check(lm.scores(odd), odd_rows)
    assert lm.scores(nothing).count() == 0
    # A missing id is not held out; the end is the only token there is.
    assert {r.train_tokens for r in lm.scores(all_missing).collect()} == {3}


@pytest.mark.parametrize("order, strengths", [(2, (3.0,)), (4, (5.0, 2.0, 0.5))])
def test_other_orders(documents, rows, order, strengths):
    check(lm.scores(documents, order=order, strengths=strengths, block_bytes=100_000), rows, strengths, order)


def test_few_shards(documents, rows):
    check(lm.scores(documents, block_bytes=20_000, shards=3), rows)


def test_equal_rows_are_dealt_over_the_blocks(spark):
    """A third of all rows alike, without id."""
    rows = [(None, "the same words again")] * 400 + [(i, f"word{i % 7} and word{i % 5}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(lm.scores(df, block_bytes=2000), rows)


def automaton(texts, order=3, strengths=(4.0, 2.0)):
    found = lm.Tokens.of([t.encode() for t in texts], order)
    counts = [c.astype(float) for c in found.counts(np.ones(len(texts), bool))]
    return found, lm.Automaton(found, counts, int(counts[0].sum()), len(counts[0]), len(texts), strengths)


def behind(found, machine, history):
    """The state after a history of words from the start, and its true n-grams, by walking the automaton."""
    texts = [" ".join(history)]
    tokens = lm.Tokens.of([t.encode() for t in texts])
    places = [{int(k): i for i, k in enumerate(keys)} for keys in found.keys]
    state = np.array([machine.start])
    for i in range(len(history)):
        grams = [np.array([places[n].get(int(tokens.keys[n][tokens.at[n][i]]), -1) if tokens.at[n][i] >= 0 else -1]) for n in range(3)]
        state, _ = machine.step(state, grams)
    return int(state[0])


def test_probabilities_add_up():
    """From every state its arcs, and behind its failure arcs those that it lacks, and one unknown word make one."""
    found, machine = automaton(["a b a b c", "b a c", "c c c a"])
    words, arcs = len(found.keys[0]), {}
    state_of = {}
    for n in range(3):
        for gram in range(len(found.keys[n])):
            where = int(np.flatnonzero(found.at[n] == gram)[0])
            head = found.head[n][gram]
            source = 0 if n == 0 else machine.start if head < 0 else state_of[n - 1, int(head)]
            arcs.setdefault(source, {})[int(found.at[0][where])] = machine.weight[n][gram]
            if n < 2 and machine.target[n][gram] > 0:
                state_of[n, gram] = int(machine.target[n][gram])
    assert set(arcs) == set(range(len(machine.failure)))
    for state in arcs:
        weights, away, at = {}, 0.0, state
        while True:
            for word, weight in arcs[at].items():
                weights.setdefault(word, away + weight)
            if not at:
                break
            away, at = away + machine.failure_weight[at], int(machine.failure[at])
        unknown = 0.5 / (found.sizes.sum() + 0.5 * (words + 1))
        assert len(weights) == words
        assert sum(10 ** w for w in weights.values()) + 10 ** away * unknown == pytest.approx(1)


def test_failure_arcs_chain_to_the_empty_history():
    found, machine = automaton(["a b c", "b d", "d e"])
    chain = [behind(found, machine, ["a", "b"])]
    while chain[-1]:
        chain.append(int(machine.failure[chain[-1]]))
    # After "a b" the state has two words, then one, then none; "e" is known to the last alone.
    assert [int(machine.level[s]) for s in chain] == [2, 1, 0]
    both = lm.Tokens.of([t.encode() for t in ["a b c", "b d", "d e", "a b e"]])
    counts = [c.astype(float) for c in both.counts(np.array([True, True, True, False]))]
    machine = lm.Automaton(both, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), 3, (4.0, 2.0))
    at = int(both.sizes[:3].sum()) + 2
    state = np.array([next(s for s in np.flatnonzero(machine.level == 2) if machine.failure[s] and
                           machine.target[1][both.at[1][at - 1]] == s)])
    _, weight = machine.step(state, [n[[at]] for n in both.at])
    word = both.at[0][at]
    down = machine.failure_weight[state[0]] + machine.failure_weight[machine.failure[state[0]]]
    assert weight[0] == pytest.approx(down + np.log10(machine.base[word]))


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 512])
def test_stretches_carry_the_state(stretch):
    draw = np.random.default_rng(1)
    found, machine = automaton([" ".join(draw.choice(list("abcd"), n)) for n in (0, 1, 2, 3, 40, 90)])
    assert machine.traverse(found, stretch) == pytest.approx(machine.traverse(found, 1000))


def test_packed_numbers():
    draw = np.random.default_rng(0)
    for keys in (np.sort(draw.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)), np.empty(0, np.uint64)):
        assert (np.cumsum(lm.inflate(lm.deflate(lm.gaps(keys)), np.uint64), dtype=np.uint64) == keys).all()


def test_better_than_single_words_on_unseen_documents(spark, medium):
    got = [r for r in lm.scores(spark.read.parquet(f"{medium}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
