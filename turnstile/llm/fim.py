"""Fill-in-the-middle: each text is cut at two ranks and put together anew around marks.

A rank counts units: code points, or the stretches that start at a pattern's matches. The units of a batch of texts
lie in an indexable skip list. Its base lane has a link for every unit; every lane above keeps the first unit of each
text and about one in eight of the others, and each link carries how many units, code points and bytes it spans, summed
from the links below it. A cut starts at its text's first link in the top lane and takes every link whose span, added to what it has
passed, does not go beyond the rank, then goes one lane down; so it ends on the rank exactly, with the code points and
bytes before it. All cuts of a batch descend together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from turnstile.llm.common import free_name, in_batches, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are cut, and percent of these whose suffix comes first.
CUT_PERCENT, SPM_PERCENT = 90, 20
#: Goes before a document's id where its cuts and form are drawn.
SALT = "1:"
#: Texts of a batch are taken together up to so many bytes; a longer text comes alone (about 30 bytes of memory a byte).
TOGETHER_BYTES = 1 << 20

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: A link of a lane is kept in the lane above if these high bits of its spread place are zero.
_HIGH_BITS = np.uint64(61)


class Lane(NamedTuple):
    """Links of one lane in the order of the texts; `below` is a link's place in the lane below."""

    units: np.ndarray
    chars: np.ndarray
    bytes: np.ndarray
    below: np.ndarray


class SkipList:
    """The units of several texts, from each unit's widths in code points and bytes and each text's number of units."""

    def __init__(self, chars: np.ndarray, width: np.ndarray, counts: np.ndarray):
        self.counts = counts
        heads = (np.cumsum(counts) - counts)[counts > 0]
        lanes = [Lane(np.ones(len(width), np.uint8), chars, width, np.empty(0, np.int64))]
        #: Each text's first link in the top lane; empty texts have none and need none.
        self.lanes, first = lanes, heads
        while len(lanes[-1].units) > len(heads):
            under = lanes[-1]
            # Every lane has other places to keep, so that no link stays in all of them.
            places = np.arange(1, len(under.units) + 1, dtype=np.uint64) + np.uint64(len(lanes) << 40)
            kept = places * _SPREAD >> _HIGH_BITS == 0
            kept[first] = True
            below = np.flatnonzero(kept)
            sums = (np.add.reduceat(w, below, dtype=np.int64) for w in under[:3])
            lanes.append(Lane(*sums, below))
            first = np.searchsorted(below, first)
        self.first = np.zeros(len(counts), np.int64)
        self.first[counts > 0] = first

    def before(self, texts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and bytes of each text of `texts` before its unit of that rank (0 to the number of units)."""
        at = self.first[texts]
        passed, chars, size = (np.zeros(len(ranks), np.int64) for _ in range(3))
        for lane in reversed(self.lanes):
            going = np.flatnonzero(passed < ranks)
            while len(going):
                link = at[going]
                going = going[passed[going] + lane.units[link] <= ranks[going]]
                link = at[going]
                passed[going] += lane.units[link]
                chars[going] += lane.chars[link]
                size[going] += lane.bytes[link]
                at[going] += 1
                going = going[passed[going] < ranks[going]]
            going = np.flatnonzero(passed < ranks)
            if len(lane.below):
                at[going] = lane.below[at[going]]
        return chars, size


def _char_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


def _starts(text: str, unit: re.Pattern) -> list[int]:
    """Where the units of a text begin: at its start and at every later match that is not empty."""
    return [0, *(m.start() for m in unit.finditer(text) if m.start() and m.end() > m.start())] if text else []


def skip_list(texts: pa.Array, unit: re.Pattern | None = None) -> tuple[SkipList, bytes, np.ndarray]:
    """The skip list of texts without nulls, their bytes, and the bounds of each text in them."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = raw[int(bounds[0]) : int(bounds[-1])].to_pybytes() if raw else b""
    bounds = bounds - bounds[0]
    starts = _char_starts(np.frombuffer(data, np.uint8))
    first = np.searchsorted(starts, bounds)
    if unit is None:
        width = np.diff(starts, append=len(data)).astype(np.uint8)
        return SkipList(np.ones(len(starts), np.uint8), width, np.diff(first)), data, bounds
    found = [np.asarray(_starts(t, unit), np.int64) for t in texts.to_pylist()]
    places = np.concatenate([*(f + s for f, s in zip(found, first)), np.empty(0, np.int64)])
    where = np.append(starts, len(data))[places]
    counts = np.asarray([len(f) for f in found], np.int64)
    return SkipList(np.diff(places, append=len(starts)), np.diff(where, append=len(data)), counts), data, bounds


def _together(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows whose texts have about `TOGETHER_BYTES`, with the texts."""
    for batch in batches:
        texts = strings(batch.column(text))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER_BYTES, side="right")) - 1)
            to = min(to, len(texts))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def _cut(names: list[str], text: int, unit: str | None, cut_percent: int, spm_percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pattern = re.compile(unit) if unit else None
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    p, s, m = marks
    for batch, texts in _together(batches, text):
        listed, data, bounds = skip_list(texts, pattern)
        n, rows = listed.counts, np.arange(len(texts))
        h1, h2, h3, h4 = (np.asarray(batch.column(k)) for k in range(batch.num_columns - 4, batch.num_columns))
        low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
        chars, size = listed.before(np.concatenate([rows, rows]), np.concatenate([low, high]))
        chars, size = chars.reshape(2, -1), size.reshape(2, -1)
        forms, out = [], []
        whole = (n == 0) | (h3 % 100 >= cut_percent)
        for i, plain, spm in zip(rows.tolist(), whole.tolist(), (h4 % 100 < spm_percent).tolist()):
            text_ = data[bounds[i] : bounds[i + 1]]
            if plain or any(mark in text_ for mark in marks):
                forms.append("plain")
                out.append(text_)
                continue
            a, b = size[:, i]
            forms.append("spm" if spm else "psm")
            parts = (s, text_[b:], p, text_[:a]) if spm else (p, text_[:a], s, text_[b:])
            out.append(b"".join((*parts, m, text_[a:b])))
        plain = np.asarray([f == "plain" for f in forms])
        made = [
            pa.array(n.astype(np.int64)),
            pa.array(forms, pa.string()),
            pa.array(chars[0], pa.int64(), mask=plain),
            pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *made], names=names)


def _drawn(id_col: str, salt: str) -> list[Column]:
    """Four numbers of 32 bits from the digest of an id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str | None = None, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = SALT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n (units of the text), form, prefix_chars, middle_chars (null if plain) and output to the input columns.

    Units are code points, or begin at every match of the pattern `unit` (text before the first match is a unit too).
    Both cuts and the form are drawn from the id alone: rows with one id are cut at ranks drawn by the same numbers, a
    null id draws as an empty one. Form `plain`: the text is empty or null (output: empty), holds one of the marks, or
    falls outside `cut_percent`; otherwise `psm` (prefix, suffix, middle) or `spm`. Texts of any length are taken whole.
    A name that the input already has gets underscores.
    """
    names = [free_name(docs, c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
    kinds = (LongType(), StringType(), LongType(), LongType(), StringType())
    schema = StructType([*docs.schema.fields, *(StructField(c, k) for c, k in zip(names, kinds))])
    held = [free_name(docs, f"q_h{k}") for k in range(1, 5)]
    rows = docs.select("*", *(h.alias(c) for h, c in zip(_drawn(id_col, salt), held)))
    cut = partial(_cut, schema.names, docs.columns.index(text_col), unit, cut_percent, spm_percent)
    return in_batches(rows, cut, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. Marks occur in it only where they were put, as texts with marks stay plain."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    part = lambda k: F.get(parts, F.lit(k))
    whole = F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1)))
    return F.when(form == "plain", output).otherwise(whole)
