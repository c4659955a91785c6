"""Cross-tokenizer alignment: the tokens of a byte-level BPE (A) and of a SentencePiece model (B) over the same bytes.

Every text is encoded by both; where an A and a B token end at the same byte, the text is cut and the two are linked.
The ends are found by lockstep merging: one state vector holds an A and a B pointer for every lane of a batch. In each
step the pointers whose tokens end first move on, both where they end together, and then a link and a cut come out;
finished lanes leave the vector. A document is one lane, a long one several (a lane starts anew after so many A tokens,
at the B token that ends behind), so a batch takes no more steps than a short document.

A linked pair shares its last bytes, so one token ends like the other: the two vocabularies alone bound the pairs there
can be, about half a million, however large the corpus. Counts of links per pair are one array of that size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import in_batches, strings, written

#: Where the vocabulary files lie by default; nothing of them is kept in the repository.
FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
#: A lane of the merge has at most so many A tokens.
LANE_TOKENS = 256
#: Texts are taken together up to so many bytes; a longer text comes alone.
TOGETHER_BYTES = 2 << 20

# The pattern by which a byte-level BPE of this kind cuts words, and the model name of one.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "▁"


class Side(NamedTuple):
    """One tokenizer: texts to lists of ids, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    raw: list[bytes]


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def byte_level(content: bytes) -> Side:
    """A byte-level BPE file. Strings of its special tokens inside a text are plain text.

    Where every merge makes the next id, ids are ranks and the faster library encodes; the tests hold it against the
    other over all characters. Any other file goes through the library it was written for.
    """
    whole = json.loads(content)
    model, special = whole["model"], {t["id"] for t in whole["added_tokens"]}
    characters, vocabulary = _byte_characters(), model["vocab"]
    raw = [b""] * (1 + max([*vocabulary.values(), *special]))
    for token, i in vocabulary.items():
        if i not in special:
            raw[i] = bytes(characters[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    words = whole["pre_tokenizer"] or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space") and not whole["normalizer"]
    if plain and not model.get("ignore_merges") and all(vocabulary[a + b] == 256 + n for n, (a, b) in enumerate(merges)):
        import tiktoken

        ranks = {token: i for i, token in enumerate(raw) if token}
        core = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [core.encode_ordinary(t) for t in texts], raw)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(content.decode())
    slow.encode_special_tokens = True
    return Side(lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)], raw)


def pieces(content: bytes) -> Side:
    """A SentencePiece model, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    raw = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:-1], 16)]))
        else:
            raw.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(_SPACE, " ").encode())
    return Side(lambda texts: model.encode(texts, num_threads=1), raw)


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs of which one token ends like the other, as a * len(b) + b, ascending."""

    def by_bytes(raw: list[bytes]) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for i, token in enumerate(raw):
            if token:
                found.setdefault(token, []).append(i)
        return found

    in_a, in_b, n = by_bytes(a), by_bytes(b), len(b)
    pairs = {i * n + j for i, t in enumerate(a) for k in range(len(t)) for j in in_b.get(t[k:], ())}
    pairs |= {i * n + j for j, t in enumerate(b) for k in range(len(t)) for i in in_a.get(t[k:], ())}
    return np.asarray(sorted(pairs), np.int64)


def lockstep(ends_a: np.ndarray, lanes_a: np.ndarray, ends_b: np.ndarray, lanes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B, in order, of tokens that end together.

    `lanes_a`, `lanes_b` bound each lane's tokens; ends ascend within a lane and no end occurs in two lanes.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    at_a, at_b, stop_a, stop_b = lanes_a[:-1], lanes_b[:-1], lanes_a[1:], lanes_b[1:]
    while True:
        live = (at_a < stop_a) & (at_b < stop_b)
        if not live.all():
            at_a, at_b, stop_a, stop_b = at_a[live], at_b[live], stop_a[live], stop_b[live]
        if not len(at_a):
            return np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        a, b = ends_a[at_a], ends_b[at_b]
        both = a == b
        cut_a[at_a[both]] = True
        cut_b[at_b[both]] = True
        at_a, at_b = at_a + (a <= b), at_b + (b <= a)


class Aligned(NamedTuple):
    """Texts one after another: ids of each side, bounds of each text in them, and places of the tokens that end together."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


class Pair:
    """Both tokenizers, and the pairs of their tokens that can be linked."""

    def __init__(self, content_a: bytes, content_b: bytes):
        self.sides = byte_level(content_a), pieces(content_b)
        self.sizes = [np.asarray([len(t) for t in side.raw], np.int64) for side in self.sides]
        self.pairs = possible_pairs(*(side.raw for side in self.sides))
        # How a token is written in a group: A,A|B,B;
        a, b = (range(len(side.raw)) for side in self.sides)
        written_ids = [f"{i}{end}".encode() for ids, ends in ((a, ",|"), (b, ",;")) for i in ids for end in ends]
        self.written = np.asarray(written_ids, object)

    def _tokens(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of each text on both sides; none where the bytes of either side are not a space and the text."""
        spaced = [" " + t for t in texts]
        sides = [self.sides[0].encode(spaced), self.sides[1].encode(texts)]
        for k, text in enumerate(spaced):
            whole = text.encode()
            if len(text) == 1 or any(b"".join([side.raw[i] for i in ids[k]]) != whole for side, ids in zip(self.sides, sides)):
                sides[0][k] = sides[1][k] = []
        return sides

    def align(self, texts: list[str]) -> Aligned:
        ids, bounds = [], []
        for side in self._tokens(texts):
            counts = [len(x) for x in side]
            ids.append(np.fromiter((i for x in side for i in x), np.int64, sum(counts)))
            bounds.append(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))))
        # Both sides of a text have the same bytes, so ends may run on from text to text.
        ends_a, ends_b = (np.cumsum(size[i]) for size, i in zip(self.sizes, ids))
        of_a = bounds[0]
        parts = [np.arange(start, stop, LANE_TOKENS) for start, stop in zip(of_a, of_a[1:])]
        lanes_a = np.concatenate([*parts, of_a[-1:]])
        lanes_b = np.searchsorted(ends_b, ends_a[lanes_a - 1], side="right") if len(ends_a) else lanes_a
        lanes_b[0] = 0
        return Aligned(*ids, *bounds, *lockstep(ends_a, lanes_a, ends_b, lanes_b))

    def links(self, x: Aligned) -> np.ndarray:
        """The place of each link's pair among the possible pairs."""
        return np.searchsorted(self.pairs, x.a[x.cut_a] * len(self.sides[1].raw) + x.b[x.cut_b]).astype(np.int32)

    def groups(self, x: Aligned) -> Iterator[bytes]:
        """Each text's groups, written as A ids, |, B ids, and ; between groups."""
        ends = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
        ends[0][x.cut_a] = ends[1][x.cut_b] = True
        group_a, group_b = (np.cumsum(e) - e for e in ends)
        first_b = np.concatenate(([0], x.cut_b + 1))
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        # A token stands behind all B tokens of the groups before, a B token behind all A tokens up to its own group.
        codes[np.arange(len(x.a)) + first_b[group_a]] = 2 * x.a + ends[0]
        codes[np.arange(len(x.b)) + (x.cut_a + 1)[group_b]] = 2 * (len(self.sides[0].raw) + x.b) + ends[1]
        bounds = (x.of_a + x.of_b).tolist()
        for start, end in zip(bounds, bounds[1:]):
            yield b"".join(self.written[codes[start:end]].tolist())[:-1]


class Files(NamedTuple):
    """Both vocabulary files as the driver read them, and a digest that names them."""

    a: bytes
    b: bytes
    name: str


_pairs: dict[str, Pair] = {}


def _pair(files) -> Pair:
    held = files.value
    if held.name not in _pairs:
        _pairs.clear()
        _pairs[held.name] = Pair(held.a, held.b)
    return _pairs[held.name]


def _files(spark: SparkSession, file_a: str, file_b: str):
    """The files (2 MB), read where the driver runs and sent to the workers."""
    a, b = Path(file_a).read_bytes(), Path(file_b).read_bytes()
    name = hashlib.sha256(hashlib.sha256(a).digest() + hashlib.sha256(b).digest()).hexdigest()
    return spark.sparkContext.broadcast(Files(a, b, name))


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of runs of rows whose texts have about `TOGETHER_BYTES`."""
    for batch in batches:
        texts = strings(batch.column(1))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER_BYTES, side="right")) - 1)
            to = min(to, len(texts))
            yield batch.column(0).slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _aligned(files, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = _pair(files)
    for ids, texts in _together(batches):
        x = pair.align(texts)
        cuts = [np.searchsorted(cut, of) for cut, of in ((x.cut_a, x.of_a), (x.cut_b, x.of_b))]
        within = [cut - np.repeat(of[:-1], np.diff(c)) for cut, of, c in zip((x.cut_a, x.cut_b), (x.of_a, x.of_b), cuts)]
        made = [_lists(x.a, x.of_a), _lists(x.b, x.of_b), _lists(within[0], cuts[0]), _lists(within[1], cuts[1])]
        yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"


def align(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, a_cuts, b_cuts: the tokens of each whole text, and the places of those that end together.

    The k-th link joins token a_cuts[k] of A with token b_cuts[k] of B, and both end the k-th group. A space goes before
    the text. Texts that are null, empty, or whose tokens do not spell the space and the text (a ▁ of the text itself,
    say) have no tokens. Ids may be null or repeated; other columns are ignored.
    """
    rows, name = _rows(docs, id_col, text_col)
    schema = f"{name}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
    return in_batches(rows, partial(_aligned, _files(docs.sparkSession, file_a, file_b)), schema)


def _linked(files, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = _pair(files)
    for ids, texts in _together(batches):
        x = pair.align(texts)
        bounds = np.searchsorted(x.cut_a, x.of_a)
        n = pa.array(np.diff(bounds).astype(np.int64))
        digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in pair.groups(x)], pa.string())
        made = [pa.array(np.diff(x.of_a)), pa.array(np.diff(x.of_b)), n, n, digests, _lists(pair.links(x), bounds)]
        yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def _counted(size: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the links of a task."""
    counts = np.zeros(size, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["pair", "n"])


def _weighed(held, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, best = held.value
    for batch in batches:
        links = batch.column(batch.num_columns - 1)
        sizes = links.value_lengths().to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        values = links.flatten().to_numpy(zero_copy_only=False)
        sums = [np.concatenate(([0], np.cumsum(w[values], dtype=np.int64))) for w in (best, counts)]
        made = [pa.array(s[bounds[1:]] - s[bounds[:-1]]) for s in sums]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "n_best", "count_sum"])


def summaries(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the digest of its groups, and how common its links are.

    n_best are the links whose pair has the most links of its B token in the corpus, ties included; count_sum sums up
    each link's number of links of its pair. `align` says which texts have no tokens; they have zeros and the digest ''.
    Each text is encoded once: the links are written as one number each, counted per task, summed, and sent back as one
    array with a number for each possible pair.
    """
    rows, name = _rows(docs, id_col, text_col)
    spark, files = docs.sparkSession, _files(docs.sparkSession, file_a, file_b)
    fields = f"{name}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    linked = written(in_batches(rows, partial(_linked, files), f"{fields}, links array<int>"), "links")
    pair = _pair(files)
    size, side = len(pair.pairs), len(pair.sides[1].raw)
    per_task = in_batches(linked.select("links"), partial(_counted, size), "pair int, n long")
    counted = per_task.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    highest = np.zeros(side, np.int64)
    np.maximum.at(highest, pair.pairs % side, counts)
    best = (counts == highest[pair.pairs % side]) & (counts > 0)
    weights = spark.sparkContext.broadcast((counts, best))
    return in_batches(linked, partial(_weighed, weights), f"{fields}, n_best long, count_sum long")
