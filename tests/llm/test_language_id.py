import zlib
from itertools import product

import numpy as np
import pytest

from isotrend.llm import language_id as lid


def test_held_out_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = lid.identify(docs).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    asked = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in asked]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_sources_and_ids_are_no_inputs(spark, documents):
    want = {r.text: (r.lang_pred, r.score) for r in lid.identify(documents).join(documents.select("doc_id", "text"), "doc_id").collect()}
    counts = lid.training_counts(documents, "doc_id", "text", "lang").toArrow()
    bare = documents.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang", "'q' AS source")
    got = lid.predict(bare, lid.Model.fit(counts)).join(bare.select("doc_id", "text"), "doc_id").collect()
    assert {r.text: (r.lang_pred, r.score) for r in got} == want


def test_held_out_documents_teach_nothing(spark, documents):
    held = lid.id_remainder("doc_id", 3) == 1
    counts = lid.training_counts(documents, "doc_id", "text", "lang").toPandas()
    without = lid.training_counts(documents.filter(~held), "doc_id", "text", "lang").toPandas()
    order = ["lang", "feature"]
    assert counts.sort_values(order).reset_index(drop=True).equals(without.sort_values(order).reset_index(drop=True))


def model(langs=3):
    return lid.Model([f"l{i}" for i in range(langs)], np.zeros((lid.FEATURES, langs), np.float32),
                     np.ones((lid.script_count(), langs), bool))


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(2)
    sizes = np.array([0, 5, 1, 6, 3, 0, 6])
    scores = draw.normal(0, 3, (sizes.sum(), 3)).astype(np.float32)
    got = model().label(scores, sizes, switch=4.0)
    at = 0
    for n in sizes:
        part, mine = scores[at:at + n], got[at:at + n]

        def value(path):
            return sum(part[i, s] for i, s in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:]))

        assert value(mine) == pytest.approx(max(value(p) for p in product(range(3), repeat=n)), abs=1e-4)
        at += n


@pytest.fixture(scope="module")
def trained(spark):
    spoken = {"en": "the quick brown fox jumps over the lazy dog and then it walks away with the others",
              "ru": "съешь же ещё этих мягких французских булок да выпей чаю и пойдём домой",
              "uk": "щастя їжак ґанок є ці які були дуже гарні та чудові люди", "el": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία και πάω σπίτι"}
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, spoken[lang], lang) for i, lang in zip(ids, list(spoken) * 50)]
    counts = lid.training_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    return lid.Model.fit(counts.toArrow())


def test_spans_of_mixed_text(spark, trained):
    text = "The quick fox walks. Съешь этих мягких булок, and then it jumps over: ψυχοφθόρα ΒΔΕΛΥΓΜΊΑ! 123"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = lid.predict(rows, trained).first()
    assert [(s.lang, text[s.start:s.end]) for s in row.spans] == [
        ("en", "The quick fox walks"), ("ru", "Съешь этих мягких булок"), ("en", "and then it jumps over"),
        ("el", "ψυχοφθόρα ΒΔΕΛΥΓΜΊΑ")]
    assert row.lang_pred == "en" and 0.4 < row.score < 0.6


def test_scripts_narrow_the_candidates(trained):
    assert trained.langs == ["el", "en", "ru", "uk"]
    tables = lid.letter_tables()
    found = lid.words_in(["xyz ыыы ωωω 漢字"], tables)
    scores = trained.word_scores(found)
    ruled_out = scores < lid.RULED_OUT / 2
    assert ruled_out.tolist() == [[True, False, True, True], [True, True, False, False], [False, True, True, True], [False] * 4]


def test_odd(odd, odd_rows, nothing, all_missing, documents):
    fitted = lid.Model.fit(lid.training_counts(documents, "doc_id", "text", "lang").toArrow())
    got = lid.predict(odd, fitted).collect()
    assert len(got) == len(odd_rows)
    silent = {r.doc_id for r in got if r.lang_pred == "und"}
    assert silent == {4, 5, 6} and all(r.score == 0 and not r.spans for r in got if r.doc_id in silent)
    assert len(lid.identify(odd).collect()) == len(odd_rows)
    assert lid.identify(nothing).count() == 0
    assert [(r.lang_pred, r.score) for r in lid.identify(all_missing).collect()] == [("und", 0.0)] * 3
