import hashlib
import re

from isotrend.llm import exact_dedup


def clean(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(clean(row[1]), []).append(row[0])
    out = []
    for row in rows:
        ids = groups[clean(row[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((row[0], keep, len(ids), row[0] == keep, hashlib.sha256(clean(row[1]).encode()).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def test_odd_rows(odd, odd_rows):
    assert sorted(result(exact_dedup.exact_groups(odd)), key=str) == sorted(brute(odd_rows), key=str)


def test_hot_group_with_one_salt_or_many(spark):
    rows = [(i, "the same  text" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for salts in (1, 16):
        assert sorted(result(exact_dedup.exact_groups(docs, salts=salts)), key=str) == sorted(brute(rows), key=str)


def test_empty_and_missing(nothing, all_missing):
    assert result(exact_dedup.exact_groups(nothing)) == []
    assert [r[:4] for r in result(exact_dedup.exact_groups(all_missing))] == [(None, None, 3, True)] * 3


def test_drop_keeps_columns_and_one_row_per_text(odd, odd_rows, nothing):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    assert sorted(clean(r.text) for r in got) == sorted({clean(r[1]) for r in odd_rows})
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


def test_one_row_stays_without_ids_or_with_repeated_ids(spark):
    rows = [(None, "one text"), (None, "one  text"), (None, "one\ttext"), (4, "two  words"), (4, "two words"), (9, "two\nwords"),
            (None, "two   words")]
    got = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((clean(r.text), r.doc_id) for r in got) == [("one text", None), ("two words", 4)]
