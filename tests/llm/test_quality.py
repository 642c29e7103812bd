from collections import Counter

import pytest

from isotrend.llm import quality

SPACES = "\x20\t\n\x0b\x0c\r"


def measures(text):
    text = text or ""
    words = text.encode().split()
    words = [w.decode() for w in words]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures(odd, odd_rows):
    got = sorted([tuple(r) for r in quality.rule_measures(odd).select("doc_id", *COLUMNS).collect()], key=str)
    assert got == sorted([(r[0], *measures(r[1])) for r in odd_rows], key=str)


def test_measures_of_documents(documents, rows):
    got = sorted([tuple(r) for r in quality.rule_measures(documents).select("doc_id", *COLUMNS).collect()])
    assert got == sorted((r[0], *measures(r[1])) for r in rows)


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good + f" x{i}", f"h{i % 20}") for i in range(2000)]
    rows += [(10_000 + i, bad, "spam") for i in range(500)] + [(20_000, good, "spam"), (30_000, bad, "tiny"), (30_001, good, "tiny"),
                                                               (40_000, good, None)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    kept = {r.doc_id: r.kept for r in judged.collect()}
    assert not kept[20_000] and kept[30_001] and kept[40_000] and not kept[30_000]
    assert all(kept[i] for i in range(2000))


def test_prior_by_moments(spark):
    rows = [(h, h < 5 and i < 20 or i < 2) for h in range(10) for i in range(40)]
    data = [(i, f"h{h}", 10 if fail else 60) for i, (h, fail) in enumerate(rows)]
    frame = spark.createDataFrame(data, "doc_id long, host string, n_words long").selectExpr(
        "*", "0L n_repeat_words", "0L n_symbols", "10L word_chars", "0L n_dup_lines", "1L n_lines")
    rates = {r.host: r.host_failure for r in quality.host_rates(frame).collect()}
    n, shares = 40, [0.5] * 5 + [0.05] * 5
    m = sum(shares) / 10
    spread = 10 * sum(n * (p - m) ** 2 for p in shares) / (9 * 400)
    k = (m * (1 - m) - spread) / (spread - m * (1 - m) / n)
    assert rates["h0"] == pytest.approx((20 + k * m) / (n + k))
    assert rates["h9"] == pytest.approx((2 + k * m) / (n + k))


def test_empty_and_missing(nothing, all_missing, odd):
    assert quality.judge(nothing).count() == 0
    assert quality.keep_good(nothing).count() == 0
    assert [r.kept for r in quality.judge(all_missing).collect()] == [False] * 3
    good = quality.keep_good(odd)
    assert good.columns == odd.columns
    assert {r.doc_id for r in good.collect()} == {1, 2, 3, 7, 8, None, 9, 12}
