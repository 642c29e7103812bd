"""Personal data by anchors: Aho-Corasick finds them, local parsers expand and validate what is around."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = DIGITS | LETTERS | frozenset("-")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("iban", "account", "acct", "ssn")
# Cues that a secret follows behind a colon or equals sign, and the fixed starts of issued keys with the length of what follows.
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key")
ISSUED = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "xoxb-": 20}
VALUE = DIGITS | LETTERS | frozenset("_-+/.")
LEAST_SECRET = 8
TRAILING = frozenset(".,;:!?)]}'\"")

Span = tuple[str, int, int]


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(form)))
    for start in ISSUED:
        found.add_word(start, ("issued", len(start)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around an at-sign; its local part starts no earlier than ``free``."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        further = run_end(text, end + 1, LABEL)
        if further == end + 1:
            break
        end, labels = further, labels + 1
    return (start, end) if labels > 1 else None


def ip_at(text: str, at: int, end: int) -> tuple[int, bool] | None:
    """End of four dotted numbers whose first lies at ``at`` to ``end``, and whether each is at most 255."""
    valid = small(text, at, end)
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None
        further = run_end(text, end + 1, DIGITS)
        if further == end + 1:
            return None
        valid = valid and small(text, end + 1, further)
        end = further
    return end, valid


def small(text: str, start: int, end: int) -> bool:
    number = text[start:end].lstrip("0")
    return len(number) <= 3 and (not number or int(number) <= 255)


def card_at(text: str, at: int) -> tuple[int, bool]:
    """End of a chain of digits with at most one space or hyphen between them, and whether it is a card number."""
    n, end, digits = len(text), at, []
    while True:
        if end < n and text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            end += 1
        else:
            break
    return end, 13 <= len(digits) <= 19 and luhn("".join(digits))


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def phone_at(text: str, at: int) -> tuple[int, bool] | None:
    """End of a number behind a plus sign at ``at``, and whether it has 9 to 15 digits."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_end(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return end, 9 <= sum(c in DIGITS for c in text[at:end]) <= 15


def link_end(text: str, after: int) -> tuple[int, int]:
    """Where what is no white space or bracket ends, and the end without closing marks."""
    stop = after
    while stop < len(text) and not text[stop].isspace() and text[stop] not in "<>\"'|":
        stop += 1
    end = stop
    while end > after and text[end - 1] in TRAILING:
        end -= 1
    return stop, end


def address_at(text: str, at: int, after: int, end: int) -> tuple[int, int] | None:
    """A link that names a person or a machine: with a user before an at-sign, or with a numeric host."""
    end = max(end, after)
    slash = text.find("/", after, end)
    host = text[after:end if slash < 0 else slash]
    user, sign, _ = host.rpartition("@")
    numbers = host.rpartition("@")[2].split(":")[0].split(".")
    numeric = len(numbers) == 4 and all(x and set(x) <= DIGITS and small(x, 0, len(x)) for x in numbers)
    return (at, end) if (sign and user) or numeric else None


def secret_at(text: str, after: int) -> tuple[int, int] | None:
    """The value that is assigned to a cue: eight characters or more with a digit among them."""
    start = run_end(text, after, frozenset(" \t\"'"))
    if start >= len(text) or text[start] not in ":=":
        return None
    start = run_end(text, start + 1, frozenset(" \t\"'"))
    end = run_end(text, start, VALUE)
    while end > start and text[end - 1] == ".":
        end -= 1
    return (start, end) if end - start >= LEAST_SECRET and any(c in DIGITS for c in text[start:end]) else None


def issued_at(text: str, at: int, after: int) -> tuple[int, int] | None:
    """A key that starts as its issuer's keys do and has their length."""
    length = ISSUED[text[at:after]]
    end = run_end(text, after, DIGITS | LETTERS | frozenset("-")) if text[after - 1] == "-" else run_end(text, after, DIGITS | LETTERS)
    exact = end - after >= length if text[after - 1] == "-" else end - after == length
    return (at, end) if exact and any(c in DIGITS for c in text[after:end]) else None


def account_at(text: str, after: int) -> tuple[int, int] | None:
    """The number that follows a cue: an IBAN by its check digits, ddd-dd-dddd, or 6 to 17 digits."""
    start = run_end(text, after, frozenset(" \t:#=.-"))
    for word in ("number", "no.", "no", "is"):
        if text[start:start + len(word)].lower() == word:
            start = run_end(text, start + len(word), frozenset(" \t:#=."))
            break
    if start == after:
        return None
    if text[start:start + 2].isalpha() and text[start:start + 2].isascii():
        end, kept = start, []
        while end < len(text) and len(kept) < 34:
            if text[end] in DIGITS or text[end] in LETTERS:
                kept.append(text[end].upper())
                end += 1
                if len(kept) == 4 and not "".join(kept[2:]).isdigit():
                    return None
                if len(kept) >= 15 and iban("".join(kept)) and (end == len(text) or text[end] not in DIGITS | LETTERS):
                    return start, end
            elif text[end] == " " and end + 1 < len(text) and text[end + 1] in DIGITS | LETTERS:
                end += 1
            else:
                break
        return None
    end = run_end(text, start, DIGITS | frozenset("-"))
    while end > start and text[end - 1] == "-":
        end -= 1
    found = text[start:end]
    digits = found.replace("-", "")
    return (start, end) if digits and found[0] != "-" and 6 <= len(digits) <= 17 else None


def iban(kept: str) -> bool:
    if not (kept[:2].isalpha() and kept[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in kept[4:] + kept[:4])) % 97 == 1


def find(text: str | None, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text, by kind and then by start. A missing text has none.

    Spans of one kind never overlap: each kind goes on where its last match, valid or not, ended.
    """
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    free = dict.fromkeys(KINDS, 0)
    digits_end = link_stop = link_last = 0

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            found[kind].append((start, end))

    for last, (kind, length) in automaton.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= digits_end:
                digits_end = run_end(text, at, DIGITS)
                if at >= free["ip"] and (hit := ip_at(text, at, digits_end)):
                    take("ip", at, *hit)
                if at >= free["card"]:
                    take("card", at, *card_at(text, at))
        elif kind == "@":
            if at >= free["email"] and (hit := email_at(text, at, free["email"])):
                take("email", *hit)
        elif kind == "+":
            if at >= free["phone"] and (hit := phone_at(text, at)):
                take("phone", at, *hit)
        elif kind == "scheme":
            if at >= free["address"]:
                # All schemes in one stretch without white space end where it ends; it is looked through once.
                if last + 1 > link_stop:
                    link_stop, link_last = link_end(text, last + 1)
                if hit := address_at(text, at, last + 1, link_last):
                    take("address", *hit)
        elif kind in ("secret", "issued"):
            if at >= free["secret"] and (at == 0 or not text[at - 1].isalnum()) and (
                    hit := secret_at(text, last + 1) if kind == "secret" else issued_at(text, at, last + 1)):
                take("secret", *hit)
        elif (at == 0 or not text[at - 1].isalnum()) and at >= free["account"] and (hit := account_at(text, last + 1)):
            take("account", *hit)
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` per input row; ``spans`` are (kind, start, end, value) in code points, end exclusive.

    One pass over the scan's batches, no shuffle. A missing or empty text has no spans; rows that
    repeat an id are answered each; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches):
        automaton = anchors()
        for batch in batches:
            spans = []
            for value in batch.column(1):
                body = value.as_py()
                spans.append([{"kind": k, "start": a, "end": b, "value": body[a:b]} for k, a, b in find(body, automaton)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, value: string>>")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(chosen: Callable[[Column], Column] | None = None) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    spans = F.filter("spans", chosen) if chosen else F.col("spans")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
