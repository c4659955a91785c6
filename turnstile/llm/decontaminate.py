"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' words is built once per Python worker. A document's words stream through it, keeping at
each word the longest match that ends there; a match as long as a window is an occurrence of that window, and the
state's class tells which items hold it. Items shorter than a window are one window, found by the state's marks.

Items are taken in blocks of a bounded number of bytes, each broadcast in turn, so that any number of items works;
what several blocks find in a document is merged by document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnstile.llm.common import free_name, in_batches, slices, strings, written

WINDOW = 10
#: Bytes of item texts in one broadcast block; hashing may put a little more into one.
BLOCK_BYTES = 4 << 20

# Bytes to words: A-Z lower-cased, ASCII other than letters and digits is white space, bytes of other characters stay.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences: `step` words through it, ask `items_at` a match."""

    def __init__(self, items: Iterable[tuple[int, str]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, text in items:
            word_ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if word_ids:
                sequences.append((item, word_ids))
                last = 0
                for w in word_ids:
                    last = self._extend(last, w)
        self.least = min([window, *(len(s) for _, s in sequences)])
        n = len(self.next)
        #: For a state, the state of its suffix of `window` words (-1 if its words are fewer).
        self.core = [-1] * n
        for state in sorted(range(n), key=self.length.__getitem__):
            if self.length[state] >= window:
                up = self.link[state]
                self.core[state] = state if self.length[up] < window else self.core[up]
        held: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, word_ids in sequences:
            state, length = 0, 0
            for w in word_ids:
                state, length = self.step(state, length, w)
                if length >= window:
                    held.setdefault(self.core[state], set()).add(item)
            if len(word_ids) < window:
                self.short.setdefault(state, []).append((len(word_ids), item))
        self.items = {s: tuple(sorted(i)) for s, i in held.items()}
        #: For a state, the nearest state on its suffix path that a short item marks (-1: none).
        self.marked = [-1] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            self.marked[state] = state if state in self.short else self.marked[self.link[state]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while True:
            to = self.next[state].get(w)
            if to is not None:
                return to, length + 1
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words (start, end exclusive), and the items of which a window occurs."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words]
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        at, n = 0, len(ids)
        while at < n:
            # Only a run of known words as long as the shortest window can hold one.
            if ids[at] < 0:
                at += 1
                continue
            to = at + 1
            while to < n and ids[to] >= 0:
                to += 1
            if to - at >= self.least:
                self._run(ids, at, to, spans, items)
            at = to + 1
        return _merge(spans), items

    def _run(self, ids: list[int], at: int, to: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        state = length = 0
        window, step = self.window, self.step
        for i in range(at, to):
            state, length = step(state, length, ids[i])
            if length >= window:
                spans.append((i + 1 - window, i + 1))
                items.update(self.items[self.core[state]])
            mark = self.marked[state]
            while mark > 0:
                for size, item in self.short[mark]:
                    if size <= length:
                        spans.append((i + 1 - size, i + 1))
                        items.add(item)
                mark = self.marked[self.link[mark]]


def _merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_built: dict[str, Automaton] = {}


def _automaton(block, window: int) -> Automaton:
    """The block's automaton, built once in each Python worker."""
    if block.id not in _built:
        _built.clear()
        _built[block.id] = Automaton(block.value, window)
    return _built[block.id]


class _Block(NamedTuple):
    """Broadcast items under a name that is the same in all workers."""

    id: str
    items: object

    @property
    def value(self):
        return self.items.value


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[_Block]:
    """Item texts in blocks of about `block_bytes`, by a hash of the item; one block is with the driver at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items
        rows = sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r))
        broadcast = spark.sparkContext.broadcast(rows)
        yield _Block(uuid.uuid4().hex, broadcast)


def _scan(block: _Block | None, window: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (key, text): number of words, hit spans as flat start and end numbers, items."""
    found = _automaton(block, window) if block else None
    for batch in slices(batches):
        n_words, spans, items = [], [], []
        for text in strings(batch.column(1)).to_pylist():
            words = words_of(text)
            hit, which = found.find(words) if found else ([], set())
            n_words.append(len(words))
            spans.append([x for span in hit for x in span])
            items.append(sorted(which, key=lambda i: (i is None, i or "")))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
            names=["key", "n_words", "spans", "items"],
        )


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged figures of each row of (key, n_words, list of span lists, list of item lists)."""
    for batch in slices(batches):
        hits, items, digests = [], [], []
        for spans, which in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            merged = _merge(span for flat in spans for span in zip(flat[::2], flat[1::2], strict=True))
            found = {i for several in which for i in several}
            hits.append(sum(end - start for start, end in merged))
            items.append(len(found))
            digests.append(hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(digests, pa.string())],
            names=["key", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What each document shares with the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits. Items without a text or words are passed over; items without an id
    count as one, which the digest of ids leaves out. Ids of any type are taken as text. With an empty benchmark
    nothing is hit. Equal rows give equal results; with more than one block of items, rows are
    told apart by a number of their own. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes)) or [None]
    if len(blocks) > 1:
        texts = written(texts.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("key").alias("id")).alias("key"), "text"), "numbered")
    key = texts.schema["key"].dataType.simpleString()
    schema = f"key {key}, n_words long, spans array<int>, items array<string>"
    parts = [in_batches(texts, partial(_scan, block, window), schema) for block in blocks]
    if len(parts) == 1:
        merged = parts[0].select("key", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        merged = union.groupBy("key").agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    out = in_batches(merged, _combined, f"key {key}, n_words long, n_hit long, n_items long, items_sha256 string")
    name = F.col("key.id") if len(parts) > 1 else F.col("key")
    return out.select(name.alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def cut(text: str, find, max_words: int, max_share: float) -> str | None:
    """A text without its spans of more than `max_words` hit words; None if hits are more than `max_share` of it.

    A cut joins words that were apart, so the rest is looked through again until nothing is found.
    """
    words = words_of(text)
    spans = find(words)[0]
    if _covered(spans, len(words)) > max_share:
        return None
    while spans := [s for s in spans if s[1] - s[0] > max_words]:
        text = _without(text, spans)
        spans = find(words_of(text))[0]
    return text


def _covered(spans: list[tuple[int, int]], n_words: int) -> float:
    """Share of a text's words that lie in its merged spans."""
    return sum(end - start for start, end in spans) / n_words if n_words else 0


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text with a line break in place of each of its merged spans of words."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(_TABLE)
    places, at = [], 0
    for w in words_of(text):
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    parts, at = [], 0
    for start, end in spans:
        parts.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"\n".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def _cut_batches(block: _Block, window: int, max_words: int, max_share: float, at: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _automaton(block, window)
    for batch in slices(batches):
        texts = [None if t is None else cut(t, found.find, max_words, max_share) if found.find(words_of(t))[0] else t for t in batch.column(at).to_pylist()]
        nulls = batch.column(at).is_null().to_pylist()
        keep = pa.array([t is not None or null for t, null in zip(texts, nulls, strict=True)])
        columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)


def _cut_once(max_words: int, max_share: float | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, text, list of span lists), those that lose something: the key, and the text left, null if it goes as a whole."""
    for batch in slices(batches):
        keys, texts = [], []
        for key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = _merge(span for flat in found for span in zip(flat[::2], flat[1::2], strict=True))
            gone = max_share is not None and _covered(spans, len(words_of(text))) > max_share
            spans = [s for s in spans if s[1] - s[0] > max_words]
            if gone or spans:
                keys.append(key)
                texts.append(None if gone else _without(text, spans))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = 0, max_share: float = 0.5, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without benchmark passages; same columns.

    Words inside occurrences of windows form spans. A span of more than `max_words` words is cut out (length limit);
    a document of which such words are more than `max_share` goes as a whole (coverage limit). Documents without hits, null and empty texts stay as they are.
    The result does not depend on how items fall into blocks: with several, spans of all of them are merged by
    document before anything is decided or cut, and documents that were cut are looked through by all of them again.
    """
    at = docs.columns.index(text_col)
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes))
    if not blocks:
        return docs
    if len(blocks) == 1:
        return in_batches(docs, partial(_cut_batches, blocks[0], window, max_words, max_share, at), docs.schema)
    row, last = free_name(docs, "cut_row"), free_name(docs, "cut_last")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("key"), F.col(text_col).cast("string").alias("text"))
    rounds: list[DataFrame] = []
    while True:
        scans = [in_batches(texts, partial(_scan, block, window), "key long, n_words long, spans array<int>, items array<string>") for block in blocks]
        hits = scans[0]
        for scan in scans[1:]:
            hits = hits.unionByName(scan)
        hits = hits.filter(F.size("spans") > 0).groupBy("key").agg(F.collect_list("spans").alias("spans"))
        # Coverage is a matter of the whole document, so it counts before the first cut only.
        share = max_share if not rounds else None
        cuts = written(in_batches(texts.join(hits, "key").select("key", "text", "spans"), partial(_cut_once, max_words, share), "key long, text string"), "cut")
        if cuts.isEmpty():
            break
        rounds.append(cuts.withColumn("round", F.lit(len(rounds))))
        texts = cuts.filter("text IS NOT NULL")
    if not rounds:
        return numbered.select(*docs.columns)
    changed = rounds[0]
    for cuts in rounds[1:]:
        changed = changed.unionByName(cuts)
    changed = changed.groupBy(F.col("key").alias(row)).agg(F.max_by(F.struct("text"), "round").alias(last))
    out = numbered.join(changed, row, "left").filter(F.col(last).isNull() | F.col(last)["text"].isNotNull())
    text = F.when(F.col(last).isNull(), F.col(text_col)).otherwise(F.col(last)["text"].cast(docs.schema[text_col].dataType))
    return out.withColumn(text_col, text).select(*docs.columns)
