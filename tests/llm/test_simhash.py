import random

import numpy as np
import pytest
import xxhash

from isotrend.llm import simhash


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=4):
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    distinct = list(label)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {v: root(v) for v in distinct}


def brute(rows):
    fps = [fingerprint(r[1]) for r in rows]
    label = classes(fps)
    least = {}
    for r, fp in zip(rows, fps):
        if r[0] is not None:
            least[label[fp]] = min(r[0], least.get(label[fp], r[0]))
    return [(r[0], f"{fp:016x}", least.get(label[fp])) for r, fp in zip(rows, fps)]


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()], key=str)


def test_odd_rows(odd, odd_rows):
    assert result(simhash.near_groups(odd)) == sorted(brute(odd_rows), key=str)


def test_documents(documents, rows):
    assert result(simhash.near_groups(documents)) == sorted(brute(rows), key=str)


def test_chains_in_tiny_tiles(spark):
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(150)}
    for start in list(values)[:20]:
        for _ in range(12):
            for _ in range(draw.randint(1, 5)):
                start ^= 1 << draw.randrange(64)
            values.add(start)
    values |= {sum(1 << b for b in draw.sample(range(20), 2)) for _ in range(100)}
    want = classes(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    for tile in (8, 8192):
        got = {r.node % (1 << 64): r.label % (1 << 64) for r in simhash.components(simhash.near_links(frame, 4, tile)).collect()}
        groups, expected = {}, {}
        for v in values:
            groups.setdefault(got.get(v, v), set()).add(v)
            expected.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**12, 10**15])
def test_masks_lose_no_pair(count):
    draw = random.Random(count)
    masks = [m % (1 << 64) for m in simhash._masks(count, 4, 8192)]
    for _ in range(300):
        apart = sum(1 << b for b in draw.sample(range(64), 4))
        assert any(apart & m == 0 for m in masks)


def test_tile_links_emit_a_forest():
    near = np.array([1 << b for b in range(64)] * 1, np.uint64)
    a, _ = simhash.tile_links(near, 4)
    assert len(a) == 63
    a, b = simhash.tile_links(near[:30], 4, near[30:])
    assert len(a) == 63


def test_long_chain(spark):
    links = spark.range(1, 400).selectExpr("id a", "id - 1 b")
    assert {(r.node, r.label) for r in simhash.components(links).collect()} == {(i, 0) for i in range(400)}


def test_empty_missing_and_dropping(nothing, all_missing, odd, odd_rows):
    assert simhash.near_groups(nothing).count() == 0
    assert result(simhash.near_groups(all_missing)) == [(None, "0" * 16, None)] * 3
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    # A component's row stays if it bears the component's id; rows that repeat id and text stay once.
    want = {(r[0], r[1]) for r, b in zip(odd_rows, brute(odd_rows)) if b[0] == b[2]}
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(want, key=str)
