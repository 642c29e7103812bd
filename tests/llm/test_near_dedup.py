import random

import corpus_pipeline
import numpy as np
import pytest

from isotrend.llm import near_dedup, simhash


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def classes(sets):
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and min(len(a), len(sets[j])) * 5 >= 4 * max(len(a), len(sets[j])) and alike(a, sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def brute(rows):
    """One (doc_id, text) per class: the smallest id, a missing one last; with several texts, any of them."""
    found = {}
    for row, label in zip(rows, classes([grams(r[1]) for r in rows])):
        found.setdefault(label, []).append(row)
    return sorted(str(min((r[0] is None, r[0] or 0) for r in members)) for members in found.values())


def kept(df):
    return sorted(str((r.doc_id is None, r.doc_id or 0)) for r in df.collect())


@pytest.fixture(scope="module")
def copies():
    """Texts of many words, and copies with words changed so that similarity is from 0.6 to 1."""
    draw, rows = random.Random(8), []
    for i in range(60):
        words = [f"w{draw.randrange(10 ** 6)}" for _ in range(draw.randint(60, 400))]
        rows.append((3 * i, " ".join(words)))
        for copy in (1, 2):
            changed = list(words)
            for at in draw.sample(range(len(words)), max(1, int(len(words) * draw.uniform(0.002, 0.05)))):
                changed[at] = "other"
            rows.append((3 * i + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize("tile", [4, 256])
def test_recall_and_precision_at_similarity(spark, copies, tile):
    sets = [grams(text) for _, text in copies]
    pairs = sum(alike(sets[i], sets[j]) for i in range(len(sets)) for j in range(i - i % 3, i))
    assert pairs > 40
    hot = [(1000 + i, " ".join(copies[0][1].split() + [f"end{i}"])) for i in range(40)]
    docs = spark.createDataFrame(copies + hot, "doc_id long, text string").repartition(5)
    assert kept(near_dedup.drop_near_copies(docs, tile=tile)) == brute(copies + hot)


def test_long_texts_make_small_tiles(spark, copies, monkeypatch):
    """Tiles of some hundred shingles, so that most pieces of work hold a pair of texts."""
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 300)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert kept(near_dedup.drop_near_copies(docs)) == brute(copies)


def test_pipeline_stage_links_pairs_at_similarity(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert kept(corpus_pipeline.near_copies(spark, docs, "")) == brute(copies)


def test_documents(documents, rows):
    assert kept(near_dedup.drop_near_copies(documents)) == brute(rows)


def test_one_row_stays_without_ids_or_with_repeated_ids(spark):
    body = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(None, body), (None, body + " x"), (None, body + " y")], "doc_id long, text string")
    assert near_dedup.drop_near_copies(docs).count() == 1
    docs = spark.createDataFrame([(None, body + " z"), (7, body), (7, body + " x"), (9, body + " y")], "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.drop_near_copies(docs).collect()] == [7]


def test_odd(odd, odd_rows, nothing, all_missing):
    result = near_dedup.drop_near_copies(odd)
    assert result.columns == odd.columns
    assert kept(result) == brute(odd_rows)
    assert near_dedup.drop_near_copies(nothing).count() == 0
    assert near_dedup.drop_near_copies(all_missing).count() == 1


def test_links_between_sides_only():
    sets = [np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)]
    assert near_dedup.similar_links(sets) == [(0, 1), (0, 2)]
    assert near_dedup.similar_links(sets, np.array([0, 0, 1])) == [(0, 2), (1, 2)]


def test_stage_proposes_by_simhash_alone(spark, copies, monkeypatch):
    """Without links between fingerprints only texts of one fingerprint are compared, so no other path proposes pairs."""
    asked = []

    def none(entries, radius, words):
        asked.append((radius, words))
        return entries.selectExpr("fp a", "fp b").filter("false")

    monkeypatch.setattr(near_dedup, "bucket_links", none)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    prints = {near_dedup.fingerprint(near_dedup.shingles(text.encode())) for _, text in copies}
    assert corpus_pipeline.near_copies(spark, docs, "").count() == len(prints) > len(brute(copies))
    assert asked == [(66, 4), (74, 4)]


def test_fingerprint_bits_are_majorities_and_tell_similar_from_unrelated(copies):
    sets = [near_dedup.shingles(text.encode()) for _, text in copies]
    prints = [int.from_bytes(near_dedup.fingerprint(s), "little") for s in sets]
    singles = [int.from_bytes(near_dedup.fingerprint(sets[0][i:i + 1]), "little") for i in range(len(sets[0]))]
    assert prints[0] == sum(1 << b for b in range(256) if 2 * sum(s >> b & 1 for s in singles) > len(singles))
    radius, _ = near_dedup.search_plan(0, near_dedup.bit_share(0.8, 5))
    exact = [grams(text) for _, text in copies]
    for i in range(len(sets)):
        for j in range(i):
            differ = (prints[i] ^ prints[j]).bit_count()
            if alike(exact[i], exact[j]):
                assert differ <= radius
            elif i // 3 != j // 3:
                assert differ > radius


@pytest.mark.parametrize("bucket", [4, 64, 2048])
def test_tables_of_many_bits_lose_no_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    draw, pairs = random.Random(bucket), []
    for _ in range(300):
        a = draw.getrandbits(256)
        pairs.append((a, a ^ sum(1 << b for b in range(256) if draw.random() < 0.1515)))
    values = spark.createDataFrame([(bytearray(v.to_bytes(32, "little")),) for pair in pairs for v in pair], "fp binary").repartition(3)
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in near_dedup.near_fingerprints(values, near_dedup.bit_share(0.8, 5)).collect()}
    assert found == {frozenset(v.to_bytes(32, "little") for v in pair) for pair in pairs}


@pytest.mark.parametrize("tile", [3, 8192])
def test_wide_fingerprints_in_tiles(spark, tile):
    """One bucket, cut into many tiles, against all pairs."""
    draw = random.Random(3)
    values = [draw.getrandbits(256) for _ in range(12)]
    values += [v ^ sum(1 << b for b in draw.sample(range(256), 9)) for v in values for _ in range(4)]
    names = [v.to_bytes(32, "little") for v in values]
    entries = spark.createDataFrame([(0, 0, bytearray(n), 0) for n in names], "t int, key long, fp binary, p int").repartition(4)
    links = simhash.bucket_links(entries, 20, tile, words=4)
    label = {bytes(r.node): bytes(r.label) for r in simhash.components(links).collect()}
    want = [min(n for n, w in zip(names, values) if (v ^ w).bit_count() <= 20) for v in values]
    assert [label.get(n, n) for n in names] == want


def test_chance_of_missing_a_pair():
    assert near_dedup.bit_share(0.8) == 0.1875 and 0.1515 < near_dedup.bit_share(0.8, 5) < 0.162
    draw = np.random.default_rng(4)
    for least in (1, 5):
        share = near_dedup.bit_share(0.8, least)
        radius, tables = near_dedup.search_plan(6, share, 0.05)
        places = np.array([draw.choice(256, 6, replace=False) for _ in range(tables)])
        apart = draw.random((4000, 256)) < share
        met = ~apart[:, places].any(axis=2)
        assert ((apart.sum(axis=1) > radius) | ~met.any(axis=1)).mean() < 0.06


def test_short_texts(spark):
    """Sets of four and five shingles at 0.8, whose fingerprints differ most."""
    draw, rows = random.Random(6), []
    for i in range(400):
        body = " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(8))
        rows += [(2 * i, body), (2 * i + 1, body + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kept(near_dedup.drop_near_copies(docs)) == brute(rows)
