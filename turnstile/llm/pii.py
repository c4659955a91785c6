"""Personal data found in plain and in disguised form, as spans of the source text.

Transducers rewrite a text step by step (look-alike characters, spelled digits, at/dot disguises) and keep, for every
character of the result, where it came from. Detectors run over the plain text and over the rewritten one; what the
latter adds is mapped back to source characters. Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnstile.llm.common import in_batches, slices, strings

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]
Edit = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS_AND_POINTS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: linear however long a run of name characters is."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            free = end.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: of numbers chained by points, the first four, the next four, and so on."""
    for chain in _DIGITS_AND_POINTS.finditer(text):
        numbers, at = chain[0].split("."), chain.start()
        for k in range(0, len(numbers) - 3, 4):
            end = at + sum(map(len, numbers[k : k + 4])) + 3
            if all(map(_small, numbers[k : k + 4])):
                yield at, end
            at = end + 1


def _small(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans: per kind leftmost and non-overlapping; a match that fails its test is dropped, not retried."""
    spans: list[Span] = [(s, e, "email") for s, e in _emails(text)]
    spans += [(s, e, "ip") for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
    spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(spans, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# Letters of other scripts that look like Latin ones, and marks that stand for . - @ or nothing.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "г": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
#: Full-width forms, mathematical letters and digits, circled, raised and lowered digits: folded by Unicode itself.
_FOLDED = "！-～\U0001d400-\U0001d7ff①-⑨⁰-⁹₀-₉"
_ODD = re.compile("[" + "".join(map(re.escape, _LOOKALIKES)) + _FOLDED + "]")


def fold_edits(text: str) -> Iterator[Edit]:
    if not text.isascii():
        for m in _ODD.finditer(text):
            c = m[0]
            yield m.start(), m.end(), _LOOKALIKES[c] if c in _LOOKALIKES else unicodedata.normalize("NFKC", c)


# Digits as spelled in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "dot": ".", "point": ".", "punkt": ".", "punto": ".", "plus": "+",
}
_DIGIT_WORD = "(?:" + "|".join(w for w, d in _SPELLED.items() if d.isdigit()) + ")"
_PART = rf"(?:{_DIGIT_WORD}|dot|point|punkt|punto|[0-9])"
# A text is looked through for runs only if its lower case has a spelled digit beside another, a digit or a dot word.
_POINT, _GAP = "(?:dot|point|punkt|punto)", r"[\s,;./()-]*"
_ANY_PAIR = re.compile(rf"{_DIGIT_WORD}{_GAP}(?:{_DIGIT_WORD}|{_POINT}|[0-9])|(?:[0-9]|{_POINT}){_GAP}{_DIGIT_WORD}")
_SPELLED_OUT = re.compile(_DIGIT_WORD, re.IGNORECASE)
_RUN = re.compile(rf"(?:(?<![^\W_])|(?<=[0-9]))(?:\bplus[\s-]+)?(?:\+\s?)?{_PART}(?:[\s,;/()-]*(?:{_DIGIT_WORD}|[0-9])(?![^\W\d_])|[\s,;./()-]+{_PART}(?![^\W\d_])){{2,}}", re.IGNORECASE)
_TOKEN = re.compile("|".join(sorted(_SPELLED, key=len, reverse=True)) + r"|[0-9.+]", re.IGNORECASE)


def digit_edits(text: str) -> Iterator[Edit]:
    """Runs of digits, of which some are spelled, become digits; what parts them goes. Detectors decide what they are."""
    if not _ANY_PAIR.search(text.lower()):
        return
    for run in _RUN.finditer(text):
        if not _SPELLED_OUT.search(run[0]):
            continue
        at = run.start()
        for m in _TOKEN.finditer(text, run.start(), run.end()):
            if at < m.start():
                yield at, m.start(), ""
            word = m[0].lower()
            if word in _SPELLED:
                yield m.start(), m.end(), _SPELLED[word]
            at = m.end()
        if at < run.end():
            yield at, run.end(), ""


_AT = re.compile(r"\s*[\[({<]\s*(?:at|@|arobase|arroba)\s*[\])}>]\s*|\s+(?:at|arobase|arroba)\s+|@", re.IGNORECASE)
_DOT_WORD = r"(?:\s*[\[({<]\s*(?:dot|\.|point|punkt|punto)\s*[\])}>]\s*|\s+(?:dot|point|punkt|punto)\s+)"
_DOT = re.compile(_DOT_WORD, re.IGNORECASE)
# Without one of these a text has no disguised address.
_DISGUISED = re.compile(r"[\s\[({<](?:dot|point|punkt|punto)[\s\])}>]|[\[({<]\s*(?:at|@|arobase|arroba|\.)|\s(?:at|arobase|arroba)\s+[a-z0-9-]++\.[a-z0-9]")
_SITE = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT_WORD})[A-Za-z0-9-]++)+", re.IGNORECASE)
# Around a bare `at` a plain name and a plain site must look like those of an address, or it is taken for the word.
_NAME_SHAPE = re.compile(r"(?=[^A-Za-z]*[A-Za-z]).*(?:[A-Za-z0-9][._%+-][A-Za-z0-9]|[0-9])", re.DOTALL)
_ENDING = re.compile(r"\.(?:com|org|net|edu|gov|mil|int|info|biz|name|app|dev|xyz|online|site|shop|example|test|invalid|[a-z]{2})\Z", re.IGNORECASE)
_NUMBERS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT_WORD})[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)


def address_edits(text: str) -> Iterator[Edit]:
    """at and dot in addresses become @ and a point.

    A bare `at` counts before a site with a disguised dot, or if name and site have the shape of an address.
    """
    if not _DISGUISED.search(text.lower()):
        return
    edits: set[Edit] = set()
    dots = {d.end(): d.start() for d in _DOT.finditer(text)}
    if dots:
        for m in _NUMBERS.finditer(text):
            edits.update((d.start(), d.end(), ".") for d in _DOT.finditer(text, m.start(), m.end()))
    end = 0
    for m in _AT.finditer(text):
        site = None if m.start() < end else _SITE.match(text, m.end())
        if not site:
            continue
        plain = m[0] == "@"
        hidden = list(_DOT.finditer(text, site.start(), site.end()))
        if not hidden and plain:
            continue
        # The whole name, from its end outwards: characters of names, and dot words between them.
        start, inner = m.start(), []
        while True:
            was = start
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            dot = dots.get(start) if start < was else None
            if dot is None or dot <= end or text[dot - 1] not in _LOCAL:
                break
            inner.append((dot, start, "."))
            start = dot
        if start == m.start():
            continue
        if not hidden and not inner and not re.search(r"[\[({<]", m[0]):
            shaped = _NAME_SHAPE.match(text, start, m.start())
            if not shaped or not _ENDING.search(site[0]):
                continue
        if not plain:
            edits.add((m.start(), m.end(), "@"))
            edits.update(inner)
        edits.update((d.start(), d.end(), ".") for d in hidden)
        end = site.end()
    last = 0
    for edit in sorted(edits):
        if edit[0] >= last:
            last = edit[1]
            yield edit


TRANSDUCERS: tuple[Callable[[str], Iterator[Edit]], ...] = (fold_edits, digit_edits, address_edits)


class Mapped:
    """A text and, for each of its characters, start and end in the source."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[Edit]) -> None:
        parts: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for s, e, put in [*edits, (len(self.text), len(self.text), "")]:
            parts += (self.text[at:s], put)
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            if put:
                starts += [self.starts[s]] * len(put)
                ends += [self.ends[e - 1]] * len(put)
            at = e
        self.text, self.starts, self.ends = "".join(parts), starts, ends


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and what the rewritten text adds."""
    base = detect(text)
    mapped, changed = Mapped(text), False
    for edits_of in TRANSDUCERS:
        edits = list(edits_of(mapped.text))
        if edits:
            mapped.rewrite(edits)
            changed = True
    if not changed:
        return base, base
    added = {(mapped.starts[s], mapped.ends[e - 1], kind) for s, e, kind in detect(mapped.text)}
    fresh = [a for a in added if not any(b[2] == a[2] and b[0] <= a[0] and a[1] <= b[1] for b in base)]
    return base, sorted(base + fresh, key=_order)


def _joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [find(t) for t in strings(batch.column(1)).to_pylist()]
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        every = pa.array([_joined(spans) for _, spans in found], pa.string())
        n = pa.array([len(spans) for _, spans in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, every, n], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each text; one row per row, whole texts, a null text as an empty one.

    `n_<kind>` count base spans, `spans` has all of them, `n_spans` is their number. Repeated rows give repeated
    results; an id may be null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, _report, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def redacted(text: str) -> str:
    """The text with each span, or each group of overlapping spans, replaced by the upper-case kind in <>."""
    out, at = [], 0
    merged: list[Span] = []
    for s, e, kind in find(text)[1]:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2])
        else:
            merged.append((s, e, kind))
    for s, e, kind in merged:
        out += (text[at:s], f"<{kind.upper()}>")
        at = e
    return "".join([*out, text[at:]])


def _redact(at: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced by marks; same rows and columns, null and empty texts unchanged."""
    return in_batches(docs, partial(_redact, docs.columns.index(text_col)), docs.schema)
