import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from isotrend.llm import periodic_runs
from isotrend.llm.queries import op12_periodic_runs, repeated_tails

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every (start, length, period) by comparing all words at every distance."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def by_text(texts):
    got = [[] for _ in texts]
    for i, *run in periodic_runs.runs_of([[w.encode() for w in t] for t in texts]):
        got[i].append(tuple(run))
    return got


def damaged(words, rows):
    for start, period, end in rows:
        for i in range(start, min(end, len(words))):
            words[i] = words[start + (i - start) % period]
    return words


def test_like_all_comparisons():
    draw = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 6)):
            n = draw.randint(0, 160)
            kinds = draw.choice([1, 2, 3, 5, 50])
            words = [str(draw.randrange(kinds)) for _ in range(n)]
            rows = [(a, draw.randint(1, max(1, (n - a) // 3)), draw.randint(a, n)) for a in
                    (draw.randrange(n) for _ in range(draw.randint(0, 3) if n else 0))]
            texts.append(damaged(words, rows))
        assert by_text(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=24), st.integers(1, 12), st.lists(st.integers(0, 2), max_size=24))
def test_powers_between_any_words(before, times, after):
    words = [str(w) for w in [*before, *(before or [0]) * times, *after]]
    assert by_text([words, words]) == [brute(words)] * 2


def test_extensions_are_exact():
    draw = np.random.default_rng(5)
    for kinds in (1, 2, 4):
        for size in (5, 90, 700):
            middle = draw.integers(0, kinds, size)
            middle[size // 2:] = middle[:size - size // 2]
            text = np.concatenate([[-1], middle, [-2]])
            grammar = periodic_runs.Grammar(text)
            a = draw.integers(1, size, 300)
            b = draw.integers(1, size + 1, 300)
            a, b = a[a != b], b[a != b]
            for step in (1, -1):
                got = grammar.extensions(a, b, step)
                for x, y, n in zip(a.tolist(), b.tolist(), got.tolist()):
                    want = 0
                    while text[x + step * want] == text[y + step * want]:
                        want += 1
                    assert n == want


def test_grammar_shrinks():
    text = np.concatenate([[-1], np.tile(np.arange(7), 4000), [-2]])
    levels = periodic_runs.Grammar(text).levels
    assert sum(len(level.symbols) for level in levels) < 6 * len(text)
    assert len(levels) < 60


def test_copies_do_not_run_into_each_other():
    words = [str(i) for i in range(40)]
    assert by_text([words, words, words + words]) == [[], [], []]


def test_long_texts():
    same, cycle = ["a"] * 200_000, [str(i % 89) for i in range(200_000)]
    assert by_text([same, cycle]) == [[(0, 200_000, 1)], [(0, 200_000, 89)]]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        words = damaged(words, [(a, 1 + (n - a) // (3 + g % 8), n)])
    runs = brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def shown(df):
    return [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
            for r in df.collect()]


def test_query_on_documents(spark, small, rows):
    got = dict(shown(op12_periodic_runs(spark, small)))
    assert len(got) == len(rows)
    assert got == {i: expected(i, text) for i, text, _, _ in rows if i in got}
    assert sum(n > 0 for n, *_ in got.values()) > 10


def test_odd(spark, odd, odd_rows, nothing, all_missing, tmp_path):
    odd.filter("n_chars is null or n_chars < 5000").write.parquet(f"{tmp_path}/documents.parquet")
    got = shown(op12_periodic_runs(spark, str(tmp_path)))
    want = [(r[0], expected(r[0], r[1])) for r in odd_rows if len(r[1] or "") < 5000]
    assert sorted(got, key=str) == sorted(want, key=str)
    answers = periodic_runs.periodic_runs(odd).collect()
    assert len(answers) == len(odd_rows)
    assert periodic_runs.periodic_runs(nothing).collect() == []
    assert [tuple(r) for r in periodic_runs.periodic_runs(all_missing).collect()] == [(None, [], "")] * 3
    assert repeated_tails(nothing).collect() == []
