import re

import pytest

from isotrend.llm import licenses


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def brute(rows, notices=licenses.NOTICES):
    out = set()
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        have = grams(text)
        for name, notice in notices.items():
            want = set(grams(notice))
            length, step = licenses.window_sizes(len(want))
            best = max((len(want & set(have[at:at + length])) / len(want), -at) for at in range(0, max(len(have), 1), step))
            if best[0] >= 0.8:
                out.add((doc_id, name, round(best[0], 9), -best[1]))
    return out


def result(df):
    return {(r.doc_id, r.notice, round(r.containment, 9), r.start) for r in df.collect()}


def test_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 20
    assert result(licenses.scan(docs)) == want


def test_damaged_and_shifted_notices(spark):
    grant = licenses.NOTICES["MIT grant"]
    rows = []
    for i in range(60):
        words = grant.split()
        if i % 3:
            words[(i * 7) % (len(words) - 1)] = "changed"
        rows.append((i, f"{'filler ' * i}{' '.join(words)} {'tail words here ' * (i % 9)}"))
    rows += [(100, " ".join(grant.split()[:20])), (101, "permission is hereby granted free of charge"), (102, grant.upper())]
    got = result(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == brute(rows)
    assert {r[0] for r in got} >= {i for i in range(0, 60, 3)} | {102}


def test_bands_guarantee():
    bands = licenses.bands_for(0.8, 1e-4)
    for count in range(1, 400):
        length, step = licenses.window_sizes(count)
        assert step >= count > step / 2 and length == 2 * step
        similarity = 0.8 * count / (length + 0.2 * count)
        assert (1 - similarity) ** bands <= 1e-4


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 9, 31])
def test_every_run_lies_in_a_window(count):
    length, step = licenses.window_sizes(count)
    for at in range(200):
        assert any(s <= at and at + count <= s + length for s in range(0, 400, step))


def test_odd(odd, odd_rows, nothing, all_missing):
    assert result(licenses.scan(odd)) == brute(odd_rows) == set()
    assert licenses.scan(nothing).count() == 0 and licenses.scan(all_missing).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, notices={"short": "two words"})


FAMILIES = ["MIT", "BSD 3-Clause", "ISC", "zlib", "Unlicense", "Apache 2.0", "CC0 1.0", "GPL 2", "GPL 3", "LGPL 2.1", "MPL 2.0",
            "LGPL 3 header", "AGPL 3 header", "MPL 2.0 header", "CC BY 4.0 header", "CC BY-SA 4.0 header"]


def test_damaged_whole_licenses(spark):
    rows = []
    for i, name in enumerate(FAMILIES):
        words = licenses.NOTICES[name].split()
        # One word of sixty changed: about a twelfth of the shingles, and none of the short templates'.
        for at in range(37, len(words), 60):
            words[at] = "changed"
        rows.append((i, f"{'filler words here ' * (7 * i)}{' '.join(words)} {'tail words here ' * i}"))
        # Half of a template is not the template.
        rows.append((100 + i, " ".join(licenses.NOTICES[name].split()[:len(words) // 2])))
    got = result(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == brute(rows)
    found = {r[:2] for r in got}
    for i, name in enumerate(FAMILIES):
        assert (i, name) in found and (100 + i, name) not in found
