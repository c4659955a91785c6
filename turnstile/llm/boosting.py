"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

`statistics` turns every text into a short list of numbers: shares of kinds of characters, lengths and endings of words,
how often words, three-word runs and lines come back, and how even the bytes are spread. `fit` cuts each number into
bins at its quantiles and grows trees level by level: in every node the sums of gradients and curvatures per bin give
the best cut, for logistic loss. All trees lie flattened in arrays (number asked, cut, children, value), and `score`
walks all rows through all trees at once with numpy, one step per level. Labels, language, source and id are no numbers
of a text, so no score depends on them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnstile.llm.common import in_batches, strings, written
from turnstile.llm.shingles import _Powers, mix

#: Labelled rows that the trees are fitted on at most, those with the smallest hashes of their ids. Statistics, scores
#: and verdicts cover all documents.
FIT_ROWS = 100_000
TREES, DEPTH, BINS = 80, 4, 64
#: Step of a tree, weight of the penalty on a leaf's value, and least curvature on either side of a cut.
RATE, PENALTY, LEAST = 0.2, 1.0, 2.0
#: Texts are measured together up to so many bytes; a longer text comes alone (about 80 bytes of memory a byte).
TOGETHER_BYTES = 1 << 20
#: One part of this many, by the checksum of the id, is kept from the fit; its remainder is `HELD_OUT`.
PARTS, HELD_OUT = 3, 1

_LOWER, _UPPER, _DIGIT, _BLANK, _NEWLINE, _STOP, _CRY, _SYMBOL, _OTHER, _LEAD, _TAIL = range(11)
_U = np.uint64


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    for chars, k in ((b" \t\v\f\r", _BLANK), (b"\n", _NEWLINE), (b".,;:?'\"()-", _STOP), (b"!", _CRY), (b"#*$%&|<>", _SYMBOL)):
        kind[list(chars)] = k
    kind[0x80:0xC0], kind[0xC0:] = _TAIL, _LEAD
    return kind


_KIND = _kinds()
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(row: np.ndarray, hashed: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different hashes of each row, and how often its most frequent one occurs."""
    key = np.sort((row.astype(_U) << _U(44)) | (hashed >> _U(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    owner = (key[first] >> _U(44)).astype(np.int64)
    times = np.diff(first, append=len(key))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, owner, times)
    return np.bincount(owner, minlength=rows), top


#: The names of the numbers, in their order.
STATISTICS = (
    *("chars", "words", "lines", "upper", "digits", "blanks", "stops", "cries", "symbols", "others", "wide", "entropy"),
    *("word_length", "word_spread", "single", "long", "stopped", "marked", "capital", "shouted", "letterless"),
    *("different", "variety", "top_word", "doubled", "runs", "line_words", "line_repeats", "line_stopped"),
)


def _stretches(gap: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes without gaps, none across a head."""
    first = ~gap & (np.concatenate(([True], gap[:-1])) | head[:-1])
    last = ~gap & (np.concatenate((gap[1:], [True])) | head[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def measure(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of `STATISTICS` for each text, from the bytes of all; a text without words has zeros for what words say."""
    rows, n = len(bounds) - 1, len(data)
    if not n:
        return np.zeros((rows, len(STATISTICS)))
    size, row, kind = np.diff(bounds), np.repeat(np.arange(rows), np.diff(bounds)), _KIND[data]
    of_kind = np.bincount(row * 11 + kind, minlength=rows * 11).reshape(rows, 11).astype(float)
    chars = of_kind.sum(1) - of_kind[:, _TAIL]
    spread = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256) / np.maximum(size, 1)[:, None]
    entropy = -(spread * np.log2(np.where(spread > 0, spread, 1))).sum(1)

    head = np.zeros(n + 1, bool)
    head[bounds] = True
    powers, inverses = _Powers.upto(n)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_VALUE[data] * powers[:n])))

    def hashed(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * inverses[start] ^ (stop - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def per_row(owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights, minlength=rows).astype(float)

    def count_in(of: np.ndarray) -> np.ndarray:
        """How many bytes of the kinds `of` each word has."""
        upto = np.concatenate(([0], np.cumsum(np.isin(kind, of))))
        return upto[stop] - upto[start]

    start, stop = _stretches((kind == _BLANK) | (kind == _NEWLINE), head)
    owner, length, word = row[start], stop - start, hashed(start, stop)
    words = per_row(owner)
    mean = _share(per_row(owner, length), words)
    first, last = kind[start], kind[stop - 1]
    capitals, smalls, letters = count_in([_UPPER]), count_in([_LOWER]), count_in([_LOWER, _UPPER, _LEAD])
    different, top = _repeats(owner, word, rows)
    doubled = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    three = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.empty(0, np.int64)
    runs, _ = _repeats(owner[three], mix(mix(word[three] * _U(3) + word[three + 1]) + word[three + 2]), rows)

    line_start, line_stop = _stretches(kind == _NEWLINE, head)
    line_owner = row[line_start]
    lines = per_row(line_owner)
    unlike, _ = _repeats(line_owner, hashed(line_start, line_stop), rows)
    columns = {
        "chars": np.log1p(chars),
        "words": np.log1p(words),
        "lines": np.log1p(lines),
        "entropy": entropy,
        "word_length": mean,
        "word_spread": np.sqrt(np.maximum(_share(per_row(owner, length.astype(float) ** 2), words) - mean**2, 0)),
        "single": _share(per_row(owner, length == 1), words),
        "long": _share(per_row(owner, length >= 15), words),
        "stopped": _share(per_row(owner, last == _STOP), words),
        "marked": _share(per_row(owner, (last == _SYMBOL) | (last == _CRY)), words),
        "capital": _share(per_row(owner, first == _UPPER), words),
        "shouted": _share(per_row(owner, (capitals > 1) & (smalls == 0)), words),
        "letterless": _share(per_row(owner, letters == 0), words),
        "different": _share(different, words),
        "variety": _share(different, np.sqrt(words)),
        "top_word": _share(top, words),
        "doubled": _share(per_row(owner[1:][doubled]), words),
        "runs": _share(runs, per_row(owner[three])),
        "line_words": np.log1p(_share(words, lines)),
        "line_repeats": 1 - _share(unlike, lines),
        "line_stopped": _share(per_row(line_owner, kind[line_stop - 1] == _STOP), lines),
    }
    kinds = {"upper": _UPPER, "digits": _DIGIT, "blanks": _BLANK, "stops": _STOP, "cries": _CRY, "symbols": _SYMBOL, "others": _OTHER, "wide": _LEAD}
    columns |= {name: _share(of_kind[:, k], chars) for name, k in kinds.items()}
    return np.stack([columns[name] for name in STATISTICS], axis=1)


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column(1))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at, found = 0, []
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER_BYTES, side="right")) - 1)
            to = min(to, len(texts))
            found.append(measure(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]))
            at = to
        values = np.concatenate([*found, np.empty((0, len(STATISTICS)))]).astype(np.float32)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS)
        made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "statistics"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the `STATISTICS` of each whole text, as floats. Null counts as empty, which has zeros only."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, _measured, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, statistics array<float>")


class Forest(NamedTuple):
    """All trees, one row each, nodes in the order of levels; leaves point at themselves. `start` is the score before any tree."""

    start: float
    asked: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row of numbers."""
        trees = np.arange(len(self.asked))
        at = np.zeros((len(x), len(trees)), np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            below = x[rows, self.asked[trees, at]] <= self.cut[trees, at]
            at = np.where(below, self.left[trees, at], self.right[trees, at])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, at].sum(1))))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Upper bounds of all bins but the last of each number, at its quantiles; numbers with one value have none."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    return [q[q < column.max()] for column in x.T for q in [np.unique(np.quantile(column, at, method="lower"))]]


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a node, from its sums per number and bin: everything up to that bin goes left."""
    left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - all_g**2 / (all_h + PENALTY)
    gain = np.where((left_h >= LEAST) & (right_h >= LEAST), gain, 0.0)
    place = int(np.argmax(gain))
    return float(gain.flat[place]), place


def grow(x: np.ndarray, label: np.ndarray, trees: int = TREES) -> Forest:
    """Trees for the logistic loss, each grown level by level over the binned numbers.

    With one label only, or no rows, there is no tree, and every score is the smoothed share of label 1.
    """
    rows, numbers = x.shape
    share = (label.sum() + 1) / (rows + 2)
    start, nodes = float(np.log(share / (1 - share))), 2 ** (DEPTH + 1) - 1
    asked, left, right = (np.zeros((trees, nodes), np.int32) for _ in range(3))
    left[:], right[:] = np.arange(nodes), np.arange(nodes)
    cut, value = np.zeros((trees, nodes), np.float32), np.zeros((trees, nodes))
    if not 0 < label.sum() < rows:
        return Forest(start, *(a[:0] for a in (asked, cut, left, right, value)))
    cuts = _cuts(x)
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    place = (binned + np.arange(numbers) * BINS).astype(np.int32)
    total = np.full(rows, start)
    for t in range(trees):
        chance = 1 / (1 + np.exp(-total))
        g, h = label - chance, chance * (1 - chance)
        at = np.zeros(rows, np.int64)
        for level in range(DEPTH):
            base, width = 2**level - 1, numbers * BINS
            live = np.flatnonzero(at >= base)
            key = ((at[live] - base) * width)[:, None] + place[live]
            sums = [np.bincount(key.ravel(), np.repeat(w[live], numbers), minlength=2**level * width).reshape(2**level, numbers, BINS) for w in (g, h)]
            for node in range(base, base + 2**level):
                gain, best = _best(sums[0][node - base], sums[1][node - base])
                number, bin_ = divmod(best, BINS)
                if gain <= 1e-9 or bin_ >= len(cuts[number]):
                    continue
                asked[t, node], cut[t, node] = number, cuts[number][bin_]
                left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            below = x[np.arange(rows), asked[t, at]] <= cut[t, at]
            at = np.where(below, left[t, at], right[t, at])
        leaf_g, leaf_h = (np.bincount(at, w, minlength=nodes) for w in (g, h))
        value[t] = RATE * leaf_g / (leaf_h + PENALTY)
        total += value[t][at]
    return Forest(start, asked, cut, left, right, value)


def _part(doc_id: Column) -> Column:
    """Whether the checksum of an id, as text, keeps its row from the fit; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT


def labels_of(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id and label (0 or 1), one row per id: the more frequent label; ids with as many of both have none."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    shares = known.groupBy("doc_id").agg(F.avg(label_col).alias("share")).filter("share <> 0.5")
    return shares.select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))


def fit(measured: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label_col: str = "quality") -> Forest:
    """A forest from the `statistics` of the labelled rows outside the held-out part, `rows` of them at most.

    If there are more, those whose ids have the smallest hashes are taken, so the sample does not depend on the layout.
    """
    known = measured.filter(~_part(F.col("doc_id"))).join(labels_of(labels, label_col), "doc_id")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = known.select("doc_id", "statistics", "label", order.alias("h")).orderBy("h", "doc_id").limit(rows).toArrow()
    listed = sample["statistics"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return grow(listed.reshape(-1, len(STATISTICS)), sample["label"].to_numpy().astype(float))


def _scored(forest, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = forest.value
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x), pa.float64())], names=["doc_id", "score"])


def score(measured: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 is likelier) of each row of `statistics`."""
    held = measured.sparkSession.sparkContext.broadcast(forest)
    kind = measured.schema["doc_id"].dataType.simpleString()
    return in_batches(measured.select("doc_id", "statistics"), partial(_scored, held), f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of each document.

    Learned from the labelled rows that are not held out. Every row is scored, null and empty texts too; repeated rows
    score alike, and a repeated id's rows each count in the fit. A null id has no label. Without labels of both kinds all
    scores are equal. Texts are measured once; the numbers (about 120 bytes a document) are written and read back.
    """
    measured = written(statistics(docs, id_col, text_col), "statistics")
    scored = score(measured, fit(measured, labels, rows, label_col))
    return scored.select("doc_id", _part(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
