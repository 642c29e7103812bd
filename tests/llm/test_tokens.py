import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from isotrend.llm import packing, token_files
from isotrend.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(tokenizer, odd_rows, rows):
    encoder = Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    texts = [r[1] for r in odd_rows] + [r[1] for r in rows] + [
        " lead", "trail ", "  two", "a  b", "a \n b", "a\n b", "a \nb", "x\t y", "it's 'll 1234 ab12", " ", "\n", "é́ e", "　 a 　b",
        "a\x1c b", "a \x85b", "<|endoftext|> a", "a <|endoftext|>b<|endoftext|> c", "日本 語 テキスト", "🏳️‍🌈 🏳️ x"]
    got = encoder.encode(texts) + encoder.encode(texts)
    assert [g.tolist() for g in got] == [ids_of(tokenizer, t, 0)[:-1] for t in texts] * 2


def test_token_files(spark, odd, odd_rows, tokenizer, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd, path)
    back = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in back if r.doc_id is not None] == sorted(r[0] for r in odd_rows if r[0] is not None)
    at = 0
    for r in back:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert sorted((str(r.doc_id), list(r.ids)) for r in back) == sorted((str(r[0]), ids_of(tokenizer, r[1], 0)) for r in odd_rows)
    crcs = {r.start: r.ids_crc32 for r in token_files.with_crc(token_files.read_tokens(spark, path)).collect()}
    assert crcs == {r.start: crc(r.ids) for r in back}


def test_token_files_are_selective(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write_tokens(documents, path)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["first"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    plan = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"])._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_token_files_empty(spark, nothing, all_missing, tmp_path):
    token_files.write_tokens(nothing, str(tmp_path / "none"))
    assert token_files.with_crc(token_files.read_tokens(spark, str(tmp_path / "none"))).count() == 0
    token_files.write_tokens(all_missing, str(tmp_path / "missing"))
    got = token_files.with_crc(token_files.read_tokens(spark, str(tmp_path / "missing"))).collect()
    assert sorted(tuple(r) for r in got) == [(None, i, 1, crc([0])) for i in range(3)] or \
        sorted(r.start for r in got) == [0, 1, 2]


def check_pieces(pieces, rows, tokenizer):
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.token_ids, "<u4").tolist()
        assert p.length == len(ids) > 0
        sequences[p.sequence_id].append((p.offset, p.length, p.tier))
        docs[p.doc_id].append((p.start, p.doc_tokens, ids))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and len({t for _, _, t in parts}) == 1
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(ids_of(tokenizer, r[1], 1))
    assert docs.keys() == want.keys()
    for doc, texts in want.items():
        assert sum(len(ids) for _, _, ids in docs[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            assert [i for _, _, ids in sorted(docs[doc]) for i in ids] == texts[0]
            assert {n for _, n, _ in docs[doc]} == {len(texts[0])}
    return padding, total


def test_packing_documents(documents, rows, tokenizer):
    padding, total = check_pieces(packing.pack(documents).collect(), rows, tokenizer)
    assert padding == 0 and total > 100_000


def test_packing_odd(odd, odd_rows, tokenizer, nothing, all_missing):
    check_pieces(packing.pack(odd).collect(), odd_rows, tokenizer)
    assert packing.pack(nothing).count() == 0
    assert [(p.doc_id, p.length) for p in packing.pack(all_missing).collect()] == [(None, 1)] * 3


def test_packer_gaps_and_steps():
    packer = packing.Packer(step_tokens=4096)
    draw = np.random.default_rng(1)
    pieces = []
    for doc in range(6000):
        pieces += packer.add(doc, np.arange(draw.integers(1, 3000), dtype=np.uint32))
    before = len(packer.pool)
    assert packing.KEPT_BACK <= before < packing.GATHERED
    pieces += packer.fill()
    assert not packer.pool and not packer.rests
    steps, filled = defaultdict(set), defaultdict(int)
    for doc, total, start, length, sequence, offset, tier, step, ids in pieces:
        steps[step].add((sequence, tier))
        filled[sequence] += length
    whole = [s for s in steps.values() if sum(t for _, t in s) == 4096]
    assert all(len({t for _, t in s}) == 1 and sum(t for _, t in s) <= 4096 for s in steps.values())
    assert len(whole) >= len(steps) - 12
    assert all(n & (n - 1) == 0 for n in filled.values())
    # Few documents are cut: most lie in one piece, or are longer than a window.
    assert len(pieces) < 2.2 * 6000
