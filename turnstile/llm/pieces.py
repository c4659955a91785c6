"""SentencePiece encoding with seeded merge-dropout, and decoding that gives the text back.

A text is escaped (space becomes ▁, one ▁ comes first) and merged bottom-up by an agenda: the best-ranked candidate
pair is taken first, the leftmost among equals. A keyed hash of the candidate and its surroundings decides whether it
is skipped, so a seed always gives the same segmentation and another seed another one. Characters that the vocabulary
lacks, and a ▁ of the text itself, become byte pieces; therefore every segmentation decodes to the text.

No piece holds ▁ after another character, so a text is merged in units of a run of ▁ and what follows. The key of a unit
is drawn by the text and the unit's place in it, so every occurrence has its own skips. The agendas of many units are
worked off in step: a row for each unit holds its symbols and the ranks of their pairs, each step takes every row's best
candidate, asks the row's key, and merges or skips. A symbol stays at the place of its first character, so the pieces of
all units stand in the order of the text at the end. Long units have a heap of their own.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import in_batches, slices, strings

#: Where the vocabulary file lies by default; nothing of it is kept in the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20
#: Units whose agendas are worked off together.
TOGETHER = 1 << 15
#: Widths of the tables of units; a unit goes into the first that holds its characters, longer ones have a heap.
WIDTHS = (4, 8, 12, 16, 32)

_SPACE = "▁"
_MASK = (1 << 64) - 1
#: Stands for a ▁ of the text itself: a number beyond all characters.
_LITERAL = 0x110000
_NEVER = np.int32((1 << 31) - 1)
# Odd multipliers of the hashes; the last mixes a candidate's code into the key.
_A, _B, _C, _D = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93


def read_pieces(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, is a byte) of each id of a BPE model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return [("" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i), model.get_score(i), model.is_byte(i)) for i in ids]


def _code(start: int, left: int, whole: int) -> int:
    """A number for the candidate of `whole` characters at `start` whose left part has `left`, spread over 64 bits."""
    return ((start << 10) + (left << 5) + whole) * _A & _MASK


def unit_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where units start in the characters of texts that begin with a space each: at a text's first character, at a line
    break and after it, and at the first space of a run."""
    space, line = points == 0x20, points == 0x0A
    first = line | (space & ~np.concatenate(([False], space[:-1])))
    first[1:] |= line[:-1]
    first[texts] = True
    return np.flatnonzero(first)


class _Pairs:
    """Pairs of symbols that make a piece: an open hash table with the piece's rank and symbol."""

    def __init__(self, pairs: dict[int, tuple[int, int]], symbols: int):
        self.symbols, self.bits = symbols, max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.into = np.full(size, -1, np.int64), np.full(size, _NEVER, np.int32), np.full(size, -1, np.int32)
        keys = np.asarray(list(pairs), np.int64)
        values = np.asarray(list(pairs.values()), np.int64).reshape(-1, 2)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each round puts one key into every free slot that is asked for
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.rank[at[put]], self.into[at[put]] = keys[put], values[put, 0], values[put, 1]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_A) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each pair; no pair has a symbol below 0."""
        keys = left.astype(np.int64) * self.symbols + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        found = self.keys[at] == keys
        return np.where(found, self.rank[at], _NEVER), self.into[at]


class Codec:
    """Encodes and decodes with one vocabulary, seed and rate of dropout."""

    def __init__(self, pieces: list[tuple[str, float, bool]], seed: int = SEED, dropout: float = DROPOUT):
        self.bytes = np.zeros(256, np.int32)
        ids: dict[str, int] = {}
        scored: list[tuple[float, str]] = []
        self.raw: list[bytes] = []
        for i, (piece, score, is_byte) in enumerate(pieces):
            if is_byte:
                value = int(piece[3:-1], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
                continue
            self.raw.append(piece.replace(_SPACE, " ").encode())
            if piece:
                ids[piece] = i
                scored.append((-score, piece))
                if len(piece) > 1 and (_SPACE in piece.lstrip(_SPACE) or "\n" in piece):
                    raise ValueError(f"a piece joins units: {piece!r}")
        #: Equal scores share a rank, so that place decides between them.
        order = {score: n for n, score in enumerate(sorted({score for score, _ in scored}))}
        self.rank = {piece: order[score] for score, piece in scored}
        # Symbols are pieces under their ids, and characters that pieces are made of; other characters never merge.
        symbols = dict(ids)
        for _, piece in scored:
            for c in piece:
                symbols.setdefault(c, len(pieces) + len(symbols))
        self.n_pieces, count = len(pieces), 1 + max(symbols.values(), default=0)
        self.char = np.full(_LITERAL + 1, -1, np.int32)
        for symbol, number in symbols.items():
            if len(symbol) == 1:
                self.char[ord(symbol)] = number
        self.known = symbols
        self.pairs = _Pairs(
            {
                symbols[piece[:k]] * count + symbols[piece[k:]]: (self.rank[piece], symbols[piece])
                for _, piece in scored
                for k in range(1, len(piece))
                if piece[:k] in symbols and piece[k:] in symbols
            },
            count,
        )
        self.key = int.from_bytes(hashlib.blake2b(str(seed).encode(), digest_size=8).digest(), "little")
        self.limit = int(dropout * (1 << 32))

    def _skipped(self, base: int, start: int, left: int, whole: int) -> bool:
        """Whether the key drops the candidate of `whole` characters at `start` whose left part has `left`."""
        return ((base ^ _code(start, left, whole)) * _D & _MASK) >> 32 < self.limit

    def _agenda(self, unit: list[str], base: int, codes: list[int] | None = None) -> list[int]:
        """Sizes of the parts that the characters of a unit are merged into, by a heap; `codes` gets each candidate's.

        A symbol is named by the position of its first character; a merged one has size 0.
        """
        n, limit = len(unit), self.limit
        rank = lambda i, end: self.rank.get("".join(unit[i:end]))
        size = [1] * n
        before = list(range(-1, n - 1))
        agenda = [(r, i, 1, 2) for i in range(n - 1) if (r := rank(i, i + 2)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, left, whole = heapq.heappop(agenda)
            if size[i] != left or size[i + left] != whole - left:
                continue
            if codes is not None:
                codes.append(_code(i, left, whole))
            if limit and self._skipped(base, i, left, whole):
                continue
            size[i + left], size[i] = 0, whole
            end, p = i + whole, before[i]
            if end < n:
                before[end] = i
                if (r := rank(i, end + size[end])) is not None:
                    heapq.heappush(agenda, (r, i, whole, whole + size[end]))
            if p >= 0 and (r := rank(p, end)) is not None:
                heapq.heappush(agenda, (r, p, size[p], end - p))
        return size

    def _in_step(self, symbols: np.ndarray, lengths: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each row (-1 behind its end) merged under its key, and which places still hold one.

        Each row has one place more than its table is wide: the end, which is the neighbour of first and last symbols.
        """
        n, wide = symbols.shape
        end = wide - 1
        symbol, column = symbols.ravel(), np.arange(wide)
        after = np.minimum(np.where(column + 1 < lengths[:, None], column + 1, end), end).astype(np.int64).ravel()
        ahead = np.broadcast_to(np.where(column > 0, column - 1, end), (n, wide)).astype(np.int64).ravel()
        size, alive = np.ones(n * wide, np.int64), (column < lengths[:, None]).ravel()
        rank, into = np.full(n * wide, _NEVER, np.int32), np.zeros(n * wide, np.int32)
        inner = np.flatnonzero((column + 1 < lengths[:, None]).ravel())
        rank[inner], into[inner] = self.pairs.find(symbol[inner], symbol[inner + 1])
        table, rows = rank.reshape(n, wide), np.arange(n)
        while len(rows):
            place = table[rows].argmin(1)
            at = rows * wide + place
            live = rank[at] != _NEVER
            rows, place, at = rows[live], place[live], at[live]
            right = rows * wide + after[at]
            whole = size[at] + size[right]
            if self.limit:
                code = ((place << 10) + (size[at] << 5) + whole).astype(np.uint64) * np.uint64(_A)
                skipped = (bases[rows] ^ code) * np.uint64(_D) >> np.uint64(32) < np.uint64(self.limit)
                rank[at[skipped]] = _NEVER
                taken = ~skipped
                row, place, at, right, whole = rows[taken] * wide, place[taken], at[taken], right[taken], whole[taken]
            else:
                row = rows * wide
            symbol[at], size[at] = into[at], whole
            rank[right], alive[right] = _NEVER, False
            beyond, before = row + after[right], row + ahead[at]
            after[at] = after[right]
            ahead[beyond] = place
            last, first = after[at] == end, ahead[at] == end
            rank[at], into[at] = self.pairs.find(symbol[at], np.where(last, -1, symbol[beyond]))
            # The end's place takes what no first symbol needs and stays without a rank.
            rank[before], into[before] = self.pairs.find(np.where(first, -1, symbol[before]), symbol[at])
        return symbol.reshape(n, wide), alive.reshape(n, wide)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the pieces; none for an empty text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; units of all texts are merged together."""
        ids, bounds = self.encode_flat(texts)
        return [ids[start:stop] for start, stop in zip(bounds, bounds[1:])]

    def _keys(self, text: str, n: int) -> np.ndarray:
        """The key of each unit, drawn by the whole text and the unit's place."""
        seed = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), (self.key + n) & _MASK) if self.limit else 0
        x = np.arange(n, dtype=np.uint64) * np.uint64(_A) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_B)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_C)
        return x ^ (x >> np.uint64(31))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text's."""
        whole = "".join([" " + t for t in texts if t])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        starts = unit_starts(points, begins[:-1][np.diff(begins) > 0])
        space, literal = points == 0x20, points == ord(_SPACE)
        escaped = np.where(space, ord(_SPACE), np.where(literal, _LITERAL, points))
        symbol, alive = self.char[escaped], np.ones(len(points), bool)
        lengths = np.diff(starts, append=len(points))
        counts = np.diff(np.searchsorted(starts, begins)).tolist()
        bases = np.concatenate([*(self._keys(t, n) for t, n in zip(texts, counts) if n), np.empty(0, np.uint64)])
        narrow = 1
        for width in WIDTHS:
            fitting = np.flatnonzero((lengths > narrow) & (lengths <= width))
            narrow, places = width, np.arange(width + 1)
            for units in (fitting[k : k + TOGETHER] for k in range(0, len(fitting), TOGETHER)):
                where = starts[units][:, None] + places
                inside = places < lengths[units][:, None]
                table = np.where(inside, symbol[np.minimum(where, len(points) - 1)], -1).astype(np.int32)
                merged, left = self._in_step(table, lengths[units], bases[units])
                symbol[where[inside]], alive[where[inside]] = merged[inside], left[inside]
        for unit in np.flatnonzero(lengths > narrow).tolist():
            start = int(starts[unit])
            chars = [_SPACE if p == 0x20 else "" if p == ord(_SPACE) else chr(p) for p in points[start : start + int(lengths[unit])].tolist()]
            # A ▁ of the text is no character of any piece; a lone surrogate stands for it.
            chars = [c or "\ud800" for c in chars]
            for i, size in enumerate(self._agenda(chars, int(bases[unit]))):
                alive[start + i] = size > 0
                if size > 1:
                    symbol[start + i] = self.known["".join(chars[i : i + size])]
        return self._spelled(symbol[alive], points[alive], np.flatnonzero(alive), begins)

    def _spelled(self, symbol: np.ndarray, points: np.ndarray, places: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols in order, those without an id as the bytes of their character, and the bounds of texts."""
        strange = np.flatnonzero((symbol < 0) | (symbol >= self.n_pieces))
        spelled = [chr(p).encode("utf-8", "surrogatepass") for p in points[strange].tolist()]
        counts = np.ones(len(symbol), np.int64)
        counts[strange] = [len(x) for x in spelled]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = np.repeat(symbol, counts)
        if len(strange):
            values = np.frombuffer(b"".join(spelled), np.uint8)
            sizes = counts[strange]
            within = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids[np.repeat(ends[strange], sizes) + within] = self.bytes[values]
        return ids.astype(np.int32), ends[np.searchsorted(places, begins)]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Vocabulary(NamedTuple):
    """The pieces, and a digest of all of them that names them in every worker."""

    name: str
    pieces: list[tuple[str, float, bool]]


_codecs: dict[tuple, Codec] = {}


def _codec(vocabulary, seed: int, dropout: float) -> Codec:
    held = vocabulary.value
    name = (held.name, seed, dropout)
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(held.pieces, seed, dropout)
    return _codecs[name]


def _encoded(vocabulary, seed: int, dropout: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = _codec(vocabulary, seed, dropout)
    for batch in slices(batches, 128):
        texts = strings(batch.column(1)).to_pylist()
        ids, bounds = codec.encode_flat(texts)
        listed, at = ids.tolist(), bounds.tolist()
        exact = [codec.decode(listed[start:stop]) == text for start, stop, text in zip(at, at[1:], texts)]
        tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        counts = pa.array(np.diff(bounds).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), counts, tokens, pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "token_ids", "lossless"])


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary, read where the driver runs and sent to the workers; its size is that of the model file."""
    pieces = read_pieces(path)
    return spark.sparkContext.broadcast(Vocabulary(hashlib.sha256(repr(pieces).encode("utf-8", "surrogatepass")).hexdigest(), pieces))


def encode(docs: DataFrame, seed: int = SEED, dropout: float = DROPOUT, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text: doc_id, n_tokens, token_ids, and whether decoding gave the text back.

    A null or empty text has no tokens and counts as lossless. Equal texts have equal tokens under one seed. Ids may
    be null or repeated; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, token_ids array<int>, lossless boolean"
    return in_batches(rows, partial(_encoded, _vocabulary(docs.sparkSession, model), seed, dropout), schema)


def _decoded(vocabulary, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = _codec(vocabulary, 0, 0.0)
    for batch in slices(batches, 128):
        texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(tokens: DataFrame, model: str = MODEL, id_col: str = "doc_id", tokens_col: str = "token_ids") -> DataFrame:
    """The texts of token ids: doc_id, text; null ids give a null text."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("token_ids"))
    return in_batches(rows, partial(_decoded, _vocabulary(tokens.sparkSession, model)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
