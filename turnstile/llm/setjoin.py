"""Exact self-join of documents on the Jaccard similarity of their word shingles, and the groups that it links.

The method takes two savings from set relations:

* **Lists skip by position.** Every set is ordered by one global order (ordinary shingles by hash, then frequent ones
  by frequency) and only its prefix is indexed: two similar sets share a shingle there. Index lists are cut into
  blocks of set size and relative position. A probe visits the blocks whose sizes and positions can still reach the
  needed overlap; it never reads the others.
* **Answers derive from a similar set's answers.** Equal sets are one node. Each list has a leader, the set that holds
  its shingle first. A set is first compared with the closest leader of its lists only. What those comparisons link
  has its answer, so lists are probed again only across groups that are still apart: near copies of one text meet
  its leader, not each other.

Comparisons are exact, on whole sets. A bitmap only discards a pair whose symmetric difference it proves too large.
Frequent shingles are found in runs of documents and only shape the order: any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from turnstile.llm.common import free_name, in_batches, slices, strings, written
from turnstile.llm.shingles import mix, shingle_sets

_U = np.uint64
#: Fewest cells of a bitmap.
_BITMAP_BITS = 1024
_RUN_DOCS = 4096
_RUN_REPEATS = 3
#: At most so many shingles are put last for being frequent (16 bytes each are sent to every task).
FREQUENT_LIMIT = 100_000
_POSITION_BLOCKS = 10
#: Up to so many ids (8 bytes each) are broadcast to fetch texts; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def _fingerprint(s: np.ndarray) -> int:
    """64 bits that stand for a set: equal sets of any order agree."""
    total = mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U, keepdims=True)
    return int(mix(total + np.array([len(s)], dtype=_U) * _U(0xDA942042E4DD58B5)).view(np.int64)[0])


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the set's shingles in each of at least as many cells as it has shingles (a power of two)."""
    cells = max(_BITMAP_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_NODE_SCHEMA = "doc_id long, h1 long, h2 long, n int, fp long, bits array<long>, repeats int"


def _describe(k: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (id, hashes of the row, set size, fingerprint, bitmap); and for each run of documents, its frequent shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bits", pa.list_(pa.int64())), ("repeats", pa.int32())])

    def frequent(run: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(run) if run else np.empty(0, _U), return_counts=True)
        keep = counts >= _RUN_REPEATS
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.int32()), pa.array(values[keep].view(np.int64)), pa.nulls(n, schema.field("bits").type), pa.array(counts[keep].astype(np.int32))],
            schema=schema,
        )

    run: list[np.ndarray] = []
    for batch in slices(batches):
        sets = list(shingle_sets(strings(batch.column(1)), k))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                batch.column(2),
                batch.column(3),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([_bitmap(s) if len(s) else None for s in sets], schema.field("bits").type),
                pa.nulls(len(sets), pa.int32()),
            ],
            schema=schema,
        )
        run += sets
        if len(run) >= _RUN_DOCS:
            yield frequent(run)
            run = []
    yield frequent(run)


def _prefixes(k: int, percent: int, frequent, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The indexed part of each set, once per distinct set of a task: shingle, set, set size, position."""
    hashes, ranks = frequent.value
    seen: set[int] = set()
    for batch in slices(batches):
        out = []
        for s in shingle_sets(strings(batch.column(1)), k):
            if not len(s) or (fp := _fingerprint(s)) in seen:
                continue
            seen.add(fp)
            n = len(s)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                common = hashes[at] == s
                s = np.concatenate((s[~common], s[common][np.argsort(ranks[at[common]], kind="stable")]))
            out.append((s[: n - -(-percent * n // 100) + 1], fp, n))
        sizes = np.array([len(p) for p, _, _ in out], dtype=np.int64)
        whole = np.concatenate([p for p, _, _ in out]) if out else np.empty(0, _U)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(whole.view(np.int64)),
                pa.array(np.repeat(np.array([fp for _, fp, _ in out], dtype=np.int64), sizes)),
                pa.array(np.repeat(np.array([n for _, _, n in out], dtype=np.int32), sizes)),
                pa.array((np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)),
            ],
            names=["shingle", "fp", "n", "pos"],
        )


def _whole_sets(k: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        sets = [s for s in shingle_sets(strings(batch.column(1)), k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
            names=["fp", "shingles"],
        )


def _size_block(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def _candidates(index: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different roots that meet in a block which can hold an answer; a is the smaller set."""
    t = percent
    needed = lambda x, y: F.ceil(t * (x + y) / (100 + t)).cast("int")
    right = index.select("shingle", "fp", "n", "pos", "root", _size_block(F.col("n"), t).alias("size_block"), F.expr(f"pos * {_POSITION_BLOCKS} div n").cast("int").alias("pos_block"))
    most = F.floor(F.col("n") * 100 / t).cast("int")
    # A larger partner has at most `most` shingles and must hold the shared one no later than `latest`.
    latest = most - needed(F.col("n"), most)
    left = (
        index.filter((F.col("n") - F.col("pos")) * (100 + t) >= t * 2 * F.col("n"))
        .select("shingle", "fp", "n", "pos", "root", F.explode(F.sequence(_size_block(F.col("n"), t), _size_block(most, t))).alias("size_block"), F.floor(latest * _POSITION_BLOCKS / F.col("n")).cast("int").alias("latest_block"))
        .select("shingle", "fp", "n", "pos", "root", "size_block", F.explode(F.sequence(F.lit(0), F.col("latest_block"))).alias("pos_block"))
    )
    a, b = left.alias("a"), right.alias("b")
    an, bn, ap, bp = F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos")
    met = a.join(
        b,
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.size_block") == F.col("b.size_block"))
        & (F.col("a.pos_block") == F.col("b.pos_block"))
        & (F.col("a.root") != F.col("b.root"))
        & ((an < bn) | ((an == bn) & (F.col("a.fp") < F.col("b.fp"))))
        & _can_link(an, ap, bn, bp, t),
    )
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def _can_link(an: Column, ap: Column, bn: Column, bp: Column, percent: int) -> Column:
    """Whether sizes and positions of the first shared shingle leave room for enough overlap."""
    return (F.least(an, bn) * 100 >= F.greatest(an, bn) * percent) & (F.least(an - ap, bn - bp) * (100 + percent) >= (an + bn) * percent)


def _led(index: DataFrame, percent: int) -> DataFrame:
    """Each set of a list with the list's leader, the set that holds the shingle first; a is the smaller set."""
    lead = F.col("leader")
    met = index.filter((F.col("fp") != lead["fp"]) & _can_link(F.col("n"), F.col("pos"), lead["n"], lead["pos"], percent))
    own, other = F.struct("n", "fp"), F.struct(lead["n"].alias("n"), lead["fp"].alias("fp"))
    return met.select(F.least(own, other)["fp"].alias("a"), F.greatest(own, other)["fp"].alias("b")).distinct()


def _not_apart(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs, with `apart`, but for those whose bitmaps prove too large a difference.

    The larger set may have a bitmap of more cells, a power of two more; it is folded to the smaller one first.
    """
    light = nodes.select("fp", "n", "bits")
    both = pairs.join(_pick(light, "a"), "a").join(_pick(light, "b"), "b")
    half = F.size("bits_a")
    xor = lambda x, y: x.bitwiseXOR(y)
    pieces = F.sequence(F.lit(0), F.floor(F.size("bits_b") / half).cast("int") - 1)
    folded = F.aggregate(pieces, F.array_repeat(F.lit(0).cast("long"), half), lambda sum_, k: F.zip_with(sum_, F.slice("bits_b", k * half + 1, half), xor))
    folded = F.when(F.size("bits_b") == half, F.col("bits_b")).otherwise(folded)
    apart = F.aggregate(F.zip_with("bits_a", folded, lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, x: s + x)
    return both.select("a", "b", "n_a", "n_b", apart.alias("apart")).filter((100 + percent) * F.col("apart") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "apart")


def _apart_by(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose sets the known links do not join."""
    of = lambda side: known.select(F.col("fp").alias(side), F.col("root").alias(f"root_{side}"))
    rooted = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return rooted.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _sets_of(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(fp, shingles) of the sets in the pairs, from the text of one document of each; a few ids are broadcast."""
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = written(nodes.join(needed, "fp", "left_semi").select("label.doc_id"), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    named = texts.filter("doc_id IS NOT NULL").join(ids, "doc_id", "left_semi")
    return written(in_batches(named.unionByName(texts.filter("doc_id IS NULL")), partial(_whole_sets, k), "fp long, shingles array<long>"), "sets")


def _pick(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("fp").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in nodes.columns if c != "fp"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose whole sets are similar enough."""
    both = pairs.join(_pick(sets, "a"), "a").join(_pick(sets, "b"), "b")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.filter(shared * (100 + percent) >= (F.size("shingles_a") + F.size("shingles_b")) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest node that links reach, for each node of the links (a, b).

    Every round takes the smallest root of the neighbours and then the root of that root, so that long chains need
    few rounds. Neighbours are only ever summed up to a minimum, so a node with very many of them is one partial row
    per task.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        step = state.join(near, "fp").select("fp", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = state.select(F.col("fp").alias("root"), F.col("root").alias("further"))
        step = written(step.join(jump, "root").select("fp", "was", F.least("root", "further").alias("root")), "roots")
        if step.filter("root < was").isEmpty():
            return step.select("fp", "root")
        state = step.drop("was")


def _frequent(spark: SparkSession, described: DataFrame):
    """The most repeated shingles as (sorted hashes, rank by frequency), sent to every task."""
    rows = (
        described.filter("repeats IS NOT NULL").groupBy("fp").agg(F.sum("repeats").alias("repeats"))
        .orderBy(F.desc("repeats"), "fp").limit(FREQUENT_LIMIT).collect()
    )
    hashes = np.array([r.fp for r in rows], dtype=np.int64).view(_U)
    order = np.argsort(hashes)
    ranks = np.arange(len(rows), 0, -1)
    return spark.sparkContext.broadcast((hashes[order], ranks[order]))


def _row_hashes(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that tell rows of different ids or texts apart; a null id or text is told from any other."""
    parts = (doc_id.isNull(), doc_id, text.isNull(), text)
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")]


def _rooted(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1, h2, n and `first` of each row: the id and hashes of the first row of its group, null without words.

    First is the smallest id, a missing one last, and then the smallest hash.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = written(in_batches(texts.select("*", *_row_hashes(F.col("doc_id"), F.col("text"))), partial(_describe, k), _NODE_SCHEMA), "described")
    rows = described.filter("repeats IS NULL")
    label = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h1", "h2")).alias("label")
    nodes = written(rows.filter("n > 0").groupBy("fp").agg(label, F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")

    prefixes = in_batches(texts, partial(_prefixes, k, percent, _frequent(spark, described)), "shingle long, fp long, n int, pos int")
    list_, block = Window.partitionBy("shingle"), Window.partitionBy("shingle", "size_block")
    leader = F.min(F.struct("pos", "n", "fp")).over(block).alias("leader")
    index = written(
        prefixes.withColumn("size_block", _size_block(F.col("n"), percent))
        .select("shingle", "fp", "n", "pos", F.min("fp").over(list_).alias("lo"), F.max("fp").over(list_).alias("hi"), leader)
        .filter("lo < hi").drop("lo", "hi"),
        "index",
    )
    # First answers: each set and the closest of those that lead a list it is in.
    led = _not_apart(_led(index, percent), nodes, percent)
    ends = written(led.select(F.col("a").alias("fp"), "a", "b", "apart").union(led.select("b", "a", "b", "apart")), "ends")
    first_pairs = written(ends.groupBy("fp").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b").distinct(), "first_pairs")
    first = written(_linked(first_pairs, _sets_of(texts, nodes, first_pairs, k), percent), "first_links")
    # Other answers follow from those unless two sets are still apart.
    # A large group of near copies has many lists and leaders: all leaders that are still apart from a set come next.
    # They are no more than the rows of the index, whatever the size of a group.
    led_pairs = ends.select("a", "b").distinct().join(first_pairs, ["a", "b"], "left_anti")
    second_pairs = written(_apart_by(led_pairs, components(first)), "second_pairs")
    first = written(first.union(_linked(second_pairs, _sets_of(texts, nodes, second_pairs, k), percent)), "leader_links")
    known = components(first)
    rooted = written(index.drop("leader").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # Lists whose sets are all of one group have no more answers to give and are not probed.
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("shingle")
    probed = written(rooted.join(mixed, "shingle", "left_semi"), "probed")
    open_pairs = _not_apart(_candidates(probed, percent), nodes, percent).join(first_pairs.union(second_pairs), ["a", "b"], "left_anti").select("a", "b")
    open_pairs = written(open_pairs, "open_pairs")
    links = first.union(_linked(open_pairs, _sets_of(texts, nodes, open_pairs, k), percent))
    rooted = nodes.select("fp", "label").join(components(links), "fp", "left").select("fp", "label", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("label").alias("first"))
    found = rooted.join(names, "root").select("fp", "first")
    return rows.select("doc_id", "h1", "h2", "n", "fp").join(found, "fp", "left").drop("fp")


def link_documents(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size of each document's shingle set and the smallest id that links reach from it.

    Two documents are linked when 100 * shared shingles >= percent * shingles of both. Returns one row per input row:
    `doc_id`, `n_shingles`, `component_id`. A null, empty or blank text has no shingles and is linked with nothing;
    its component is its own id. Texts of fewer than `k` words have one shingle, all their words. Repeated rows give
    repeated results. A row without an id gets the smallest id of its group, null if the group has no id. Other
    columns are ignored. Ids must be integers.
    """
    rows = _rooted(docs, k, percent, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, that of the smallest id; all input columns.

    Rows are told apart by id and text, so a row goes only if a linked row stands for it, whatever its id: of rows that
    repeat an id and its text one stays, and of a group without ids too. Rows without words are linked with nothing and
    all stay.
    """
    rows = written(_rooted(docs, k, percent, id_col, text_col), "linked").filter("n > 0")
    own = F.struct("h1", "h2") == F.struct("first.h1", "first.h2")
    gone = rows.filter(~own).select("h1", "h2").distinct()
    repeated = rows.filter(own).groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    names = [free_name(docs, "q_h1"), free_name(docs, "q_h2")]
    hashes = _row_hashes(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    keyed = docs.select("*", *(h.alias(n) for h, n in zip(hashes, names)))
    met = lambda keys: (F.col(names[0]) == keys["h1"]) & (F.col(names[1]) == keys["h2"])
    kept = keyed.join(gone, met(gone), "left_anti")
    once, again = kept.join(repeated, met(repeated), "left_anti"), kept.join(repeated, met(repeated), "left_semi")
    return once.unionByName(again.dropDuplicates(names)).select(*docs.columns)
