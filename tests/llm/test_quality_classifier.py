import zlib

import numpy as np
import pytest

from isotrend.llm import quality_classifier as classifier
from isotrend.llm.queries import op11_quality_classifier


def slow_score(net, text):
    """The network by its definition: every window of the whole text, one at a time."""
    text = text or b" "
    symbols = list(text) + [classifier.PAD] * (classifier.WINDOW - 1)
    responses = [np.concatenate([net.embedding[s] for s in symbols[i:i + classifier.WINDOW]]) @ net.filters + net.bias
                 for i in range(len(text))]
    chunks = np.array([np.maximum(np.max(responses[i:i + classifier.CHUNK], axis=0), 0)
                       for i in range(0, len(text), classifier.CHUNK)], float)
    features = np.concatenate([chunks.mean(axis=0), np.sqrt(chunks.var(axis=0) + 1e-6), [np.log1p(len(text)) / 8]])
    units = np.maximum(features @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-(units @ net.out + net.out_bias[0])))


def auc(score, label):
    ranks = np.empty(len(score))
    ranks[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    ones = label == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_whole_texts_like_the_definition():
    net, draw = classifier.fresh(4), np.random.default_rng(1)
    net = net._replace(hidden_bias=draw.standard_normal(classifier.HIDDEN).astype(np.float32))
    sizes = [0, 1, 5, 7, 8, 127, 128, 129, 134, 135, 136, 255, 256, 1000, 20_000]
    texts = [draw.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes]
    got = classifier.scores(net, texts)
    assert np.allclose(got, [slow_score(net, t) for t in texts], atol=1e-5)
    # A text's score has nothing to do with the texts beside it.
    assert np.allclose(got, [classifier.scores(net, [t])[0] for t in texts], atol=1e-6)


def test_the_end_of_a_long_text_counts():
    net = classifier.fresh(4)
    text = b"the same words again and again " * 3000
    assert classifier.scores(net, [text])[0] != classifier.scores(net, [text[:-40] + b"#" * 40])[0]


def test_gradient_steps_learn_what_is_there():
    draw = np.random.default_rng(0)
    texts = [bytes(draw.choice(list(b"abcdefgh "), 300).astype(np.uint8)) for _ in range(300)]
    label = np.arange(300) % 2
    texts = [t[:150] + b"#%&!" * 4 + t[150:] if y == 0 else t for t, y in zip(texts, label)]
    net = classifier.train([classifier.excerpt(t) for t in texts[:200]], np.array([len(t) for t in texts[:200]], np.float32),
                           label[:200].astype(np.float32), np.ones(200))
    assert ((classifier.scores(net, texts[200:]) > 0.5) == label[200:]).mean() > 0.95
    again = classifier.unpacked(classifier.packed(net))
    assert all((a == b).all() for a, b in zip(net, again))


def test_excerpts_are_spread_over_the_text():
    text = bytes(range(256)) * 100
    parts = classifier.excerpt(text)
    assert len(parts) == classifier.TRAINED and parts[0] == text[:135] and parts[-1] == text[-128:]
    assert classifier.excerpt(b"") == [b" "] and classifier.excerpt(b"abc") == [b"abc"]


def test_query_on_held_out_documents(spark, medium):
    rows = op11_quality_classifier(spark, medium).collect()
    documents = spark.read.parquet(f"{medium}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert auc(np.array([s for s, _ in held]), np.array([q for _, q in held])) > 0.85


def test_labels_of_held_out_rows_change_nothing(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    turned = labels.selectExpr("doc_id", f"if({held}, 1 - quality, quality) quality")
    assert classifier.fit(documents, turned, sample=40) == classifier.fit(documents, labels, sample=40) != b""


def test_the_sample_is_bounded(spark):
    """Also where one id has most labels and most documents."""
    labels = spark.sql("select if(id < 900, 6, id) doc_id, cast(id % 2 as int) quality, 'x' text from range(2000)")
    docs = spark.sql("select if(id < 1500, 6, id - 600) doc_id, repeat('ab ', cast(id % 50 as int)) text, 1 label from range(3000)")
    rows = classifier.training_rows(docs, labels, "doc_id", "text", "quality", 30).collect()
    assert sum(r.label == 0 for r in rows) == 30 and sum(r.label == 1 for r in rows) == 30


def test_odd(spark, odd, odd_rows, nothing, all_missing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (None, 0), (10, None), (11, 7), (7, 0), (77, 1)], "doc_id long, quality int")
    rows = classifier.classify(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    net = classifier.fit(odd, labels)
    by_text = {}
    for r, s in zip(odd.select("text").collect(), classifier.score(odd, net).collect()):
        by_text.setdefault(r.text or "", set()).add(round(s.score, 5))
    assert all(len(scores) == 1 for scores in by_text.values())
    assert classifier.classify(nothing, labels).collect() == []
    assert [r.score for r in classifier.classify(all_missing, labels.limit(0)).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 1), (2, 1), (9, 1), (7, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in classifier.classify(odd.filter("doc_id < 3"), one).collect())


@pytest.mark.parametrize("size", [1, 300])
def test_gradients_by_differences(size):
    """The first step moves every parameter against the measured slope of the loss."""
    draw = np.random.default_rng(size)
    text = bytes(draw.integers(97, 110, size).astype(np.uint8))
    before = classifier.fresh(0)
    after = classifier.train([classifier.excerpt(text)], np.array([size], np.float32), np.zeros(1, np.float32), np.ones(1))
    assert classifier.scores(after, [text])[0] < classifier.scores(before, [text])[0]
