from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrend.llm import mixing


def targets(sizes, weights=(1, 2, 3)):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        base = sum(weight[s] for s in free)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / base for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(result, rows, slack):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").encode().split())
    want = targets(size)
    source_of, taken = {r[0]: r[3] for r in rows}, defaultdict(int)
    for r in result:
        s = source_of[r.doc_id]
        if r.doc_id is None:
            continue
        assert r.source_size == size[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in taken:
        assert abs(taken[s] - want[s]) <= slack(s)


def test_documents(documents, rows):
    first = mixing.mix_report(documents).collect()
    biggest = defaultdict(int)
    for r in rows:
        biggest[r[3]] = max(biggest[r[3]], len(r[1].split()))
    check(first, rows, lambda s: biggest[s])
    again = mixing.mix_report(documents.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_many_blocks_and_levels(spark):
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), "en", "hot" if i % 3 else f"s{i % 12}") for i, n in enumerate(draw.integers(0, 40, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    _, _, counted = mixing.copies(docs, block=16)
    size = {r[0]: len(r[1].split()) for r in rows}
    want = targets({s: sum(size[r[0]] for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    got = defaultdict(int)
    numbers = defaultdict(int)
    for r in counted.collect():
        got[r.source] += r.copies * size[r.doc_id]
        numbers[r.source] += r.copies
    for s, t in want.items():
        assert abs(got[s] - t) <= 41
        whole = sum(size[r[0]] for r in rows if r[3] == s)
        n = sum(r[3] == s for r in rows)
        assert abs(numbers[s] - n * t / whole) <= 3


def test_flight_keeps_totals_and_chances():
    draw = np.random.default_rng(0)
    size = draw.integers(1, 500, 400).astype(float)
    picked = np.zeros(400)
    for _ in range(300):
        p = mixing.flight(np.full(400, 0.3), size, draw.random(400))
        assert ((p == 0) | (p == 1)).sum() >= 398
        assert p.sum() == pytest.approx(120) and (p * size).sum() == pytest.approx(0.3 * size.sum())
        picked += mixing.land(p, size)
    assert np.abs(picked / 300 - 0.3).mean() < 0.04


def test_odd(odd, odd_rows, nothing, all_missing):
    result = mixing.mix_report(odd).collect()
    assert len(result) == len(odd_rows)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    taken = defaultdict(int)
    for r in result:
        taken[r.doc_id] += r.taken
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mix_report(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert [(r.size, r.taken) for r in mixing.mix_report(all_missing).collect()] == [(0, 0)] * 3


def test_one_source(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(10)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_report(docs).collect()] == [(30.0, 3)] * 10


@pytest.mark.parametrize("equal", [False, True])
def test_rows_without_id_are_documents_of_their_own(spark, equal):
    rows = [(None if i % 2 else i, " ".join(["w"] * 10 if equal else ["w"] * (5 + i % 11)), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    size, words = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        size[source] += len(text.split())
    want = targets(size)
    result = mixing.mix_report(docs).collect()
    assert len(result) == len(rows) and all(r.taken <= 3 * r.size for r in result)
    assert sum(r.taken for r in result) == pytest.approx(sum(want.values()), abs=50)
    for r in mixing.mixed(docs).collect():
        words[r.source] += len(r.text.split())
    for s, t in want.items():
        assert abs(words[s] - t) <= 16


def test_equal_rows_are_numbered_by_part(spark):
    """A key with most of all rows: numbers run from 1 without a gap, and no window holds more than one part of it."""
    rows = [(1, "a")] * 500 + [(None, "b")] * 40 + [(i, "c") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(6).withColumn("__part", F.spark_partition_id())
    found = mixing.numbered(docs, ["id", "text"], "number").collect()
    numbers = defaultdict(list)
    for r in found:
        numbers[r.id, r.text].append(r.number)
    assert len(found) == len(rows) and all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())
    plan = mixing.numbered(docs, ["id", "text"], "number")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(id" in plan and "__part" in plan.split("windowspecdefinition(")[1].split(")")[0]
