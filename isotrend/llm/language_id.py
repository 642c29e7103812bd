"""Language of texts and of their parts: scripts narrow the candidates, Viterbi labels spans of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrend.llm.common import id_remainder

UNKNOWN = "und"
PARTS, HELD_OUT = 3, 1
# Letter triples are hashed to this many features, which bounds the model whatever the corpus.
FEATURES = 1 << 17
SMOOTHING = 0.5
# Cost, in natural logarithms, of changing the language between two words.
SWITCH = 10.0
# A language is a candidate for a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.01
RULED_OUT = -1e4
# Words labelled together, divided by the number of languages, and texts turned to letters together.
WORDS, TEXTS = 1 << 23, 128
# First code points of ranges of the Unicode standard and the script that begins there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1C80, "Cyrillic"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x31A0, "Han"),
    (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Latin"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "Other"), (0x20000, "Han"))
# No letters are assigned beyond the third plane.
LETTERS_END = 0x33480


Tables = tuple[np.ndarray, np.ndarray]


def letter_tables() -> Tables:
    """Lower-case code point of every letter, 0 for what is no letter; and the script number of each."""
    lower = np.zeros(LETTERS_END + 1, np.uint32)
    for code in range(LETTERS_END):
        char = chr(code)
        if char.isalpha():
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    names = list(dict.fromkeys(name for _, name in SCRIPTS))
    starts = np.array([start for start, _ in SCRIPTS])
    number = np.array([names.index(name) for _, name in SCRIPTS])
    return lower, number[np.searchsorted(starts, np.arange(LETTERS_END + 1), "right") - 1]


def script_count() -> int:
    return len({name for _, name in SCRIPTS})


def words_in(texts: list[str], tables: Tables) -> dict[str, np.ndarray]:
    """Runs of letters in several texts: the feature of each letter, and per word its text, place and script."""
    lower, scripts = tables
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace") or b"\n\0\0\0", np.uint32)
    codes = np.concatenate([[10], np.minimum(codes, LETTERS_END), [10]]).astype(np.int64)
    small = lower[codes].astype(np.uint64)
    letter = small > 0
    at = np.flatnonzero(letter)
    # One triple per letter: itself and its neighbours, 0 at the ends of a word.
    mixed = small[at - 1] * np.uint64(0x9E3779B97F4A7C15) + small[at] * np.uint64(0xC2B2AE3D27D4EB4F) \
        + small[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    feature = (mixed >> np.uint64(47)).astype(np.int64)
    first = np.flatnonzero(~letter[at - 1])
    lengths = np.diff(np.append(first, len(at)))
    begins = at[first] - 1
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    text = np.searchsorted(starts, begins, "right") - 1
    return {"feature": feature, "first": first, "length": lengths, "text": text, "begin": begins - starts[text],
            "script": scripts[codes[at[first]]]}


def training_counts(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``lang, feature, n``: letter triples, and behind them scripts, in the training documents.

    Every task sums its own documents first, so the shuffle carries at most one row per task, language and feature.
    """
    seen = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (id_remainder(doc_id, PARTS) != HELD_OUT)) \
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        width, totals, tables = FEATURES + script_count(), {}, letter_tables()
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for one in sorted(set(langs)):
                mine = batch.column(1).filter(pa.array(langs == one))
                count = totals.setdefault(one, np.zeros(width, np.int64))
                for at in range(0, len(mine), TEXTS):
                    found = words_in(mine.slice(at, TEXTS).to_pylist(), tables)
                    count[:FEATURES] += np.bincount(found["feature"], minlength=FEATURES)
                    count[FEATURES:] += np.bincount(found["script"], found["length"], width - FEATURES).astype(np.int64)
        for one, count in totals.items():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(used), pa.string()), pa.array(used.astype(np.int32)),
                                              pa.array(count[used])], ["lang", "feature", "n"])

    return seen.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of letter triples per language, and which languages are candidates for a script."""

    def __init__(self, langs: list[str], weight: np.ndarray, allowed: np.ndarray):
        self.langs, self.weight, self.allowed = langs, weight, allowed

    @staticmethod
    def fit(counts: pa.Table) -> Model:
        langs = np.array(counts.column("lang").to_pylist(), object)
        names = sorted(set(langs))
        table = np.zeros((FEATURES + script_count(), len(names)))
        place = {lang: i for i, lang in enumerate(names)}
        table[counts.column("feature").to_numpy(), [place[x] for x in langs]] = counts.column("n").to_numpy()
        triples, scripts = table[:FEATURES], table[FEATURES:]
        weight = np.log((triples + SMOOTHING) / (triples.sum(axis=0) + SMOOTHING * FEATURES)).astype(np.float32)
        allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        # A script that no language uses rules nothing out.
        return Model(names, weight, allowed | ~allowed.any(axis=1, keepdims=True))

    def word_scores(self, found: dict[str, np.ndarray]) -> np.ndarray:
        """Log probability of each word in each language; languages that do not use its script are ruled out."""
        scores = np.empty((len(found["first"]), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            scores[:, k] = np.add.reduceat(self.weight[:, k][found["feature"]], found["first"])
        scores[~self.allowed[found["script"]]] += RULED_OUT
        return scores

    def label(self, scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """Best language of each word by Viterbi; ``sizes`` are the words of consecutive texts.

        All texts advance by one word at a time, the longest first in line, so a step is a few array
        operations over the texts that still have words.
        """
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        ordered = sizes[order]
        best_before = np.zeros(len(scores), np.int16)
        stays = np.ones(scores.shape, bool)
        value = np.zeros((len(sizes), len(self.langs)), np.float32)
        longest = int(ordered[0]) if len(ordered) else 0
        alive = np.searchsorted(-ordered, -np.arange(longest), "left")
        final = np.zeros(len(sizes), np.int64)
        for t in range(longest):
            n = alive[t]
            at = starts[:n] + t
            if t:
                now = value[:n]
                best = now.argmax(axis=1)
                change = now[np.arange(n), best] - np.float32(switch)
                best_before[at] = best
                stays[at] = now >= change[:, None]
                now = np.maximum(now, change[:, None])
                # Only differences matter; without this a long text would lose precision.
                value[:n] = now - now.max(axis=1, keepdims=True) + scores[at]
            else:
                value[:n] = scores[at]
        final[:] = value.argmax(axis=1)
        out = np.zeros(len(scores), np.int64)
        state = final.copy()
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            at = starts[:n] + t
            here = state[:n]
            out[at] = here
            state[:n] = np.where(stays[at, here], here, best_before[at])
        return out


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` per input row; ``spans`` are (lang, start, end) in code points.

    The text's language is that with the most letters in its spans and the score its share of the
    letters. A missing text, or one without letters, is ``und`` with score 0 and no spans; so is
    every text if there is nothing to learn from. Rows that repeat an id are answered each.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (id_remainder(doc_id, PARTS) == HELD_OUT).alias("held_out"),
                       F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weight, model.allowed))
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        model, tables = Model(*shared.value), letter_tables()
        room = max(1, WORDS // max(1, len(model.langs)))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                parts, sizes, words, start = [], [], 0, at
                while at < batch.num_rows and words < room:
                    texts = [t or "" for t in batch.column(2).slice(at, TEXTS).to_pylist()]
                    found = words_in(texts, tables)
                    scores = model.word_scores(found) if model.langs and len(found["first"]) else \
                        np.zeros((0, len(model.langs)), np.float32)
                    parts.append((scores, *(found[k][:len(scores)] for k in ("text", "begin", "length"))))
                    sizes.append(np.bincount(found["text"][:len(scores)], minlength=len(texts)))
                    words += len(scores)
                    at += len(texts)
                yield answer(model, batch.slice(start, at - start), parts, np.concatenate(sizes))

    def answer(model, batch, parts, sizes):
        n = batch.num_rows
        scores, begin, length = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
        text = np.repeat(np.arange(n), sizes)
        lang, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
        if len(scores):
            label, k = model.label(scores, sizes), len(model.langs)
            share = np.bincount(text * k + label, length, n * k).reshape(n, k)
            total = share.sum(axis=1)
            best = share.argmax(axis=1)
            score = np.where(total > 0, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
            lang = [model.langs[b] if t else UNKNOWN for b, t in zip(best, total)]
            cut = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (label[1:] != label[:-1])))
            last = np.append(cut[1:], len(text)) - 1
            for a, b in zip(cut.tolist(), last.tolist()):
                spans[text[a]].append({"lang": model.langs[label[a]], "start": int(begin[a]), "end": int(begin[b] + length[b])})
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(spans, pa.list_(span))],
            ["doc_id", "held_out", "lang_pred", "score", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, "
                                "spans array<struct<lang: string, start: long, end: long>>")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled documents that are not held out, then predict every document.

    What reaches the driver is the model: at most ``FEATURES`` + scripts counts per language.
    """
    return predict(docs, Model.fit(training_counts(docs, doc_id, text, lang).toArrow()), doc_id, text)
