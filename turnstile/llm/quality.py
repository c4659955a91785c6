"""Quality rules: plain counts of each document, and the likelihood ratio of its hashed n-grams.

Two multinomials over hashed n-gram buckets are counted from whole texts: one over trusted documents, one over the
whole corpus. A document's score is the sum of log(trusted / corpus) over its n-grams divided by their number, and
every document is held against one threshold. Everything is DataFrame expressions.

The n-grams are the pieces of every word, cut off from its start by three characters and what is left at its end; so
each character of each word counts once. The number of buckets grows with the corpus. Weights are whole millionths of a
nat, so sums do not depend on their order.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from turnstile.llm.common import free_name

#: Least number of hash buckets; it grows with the corpus. Weights are sent to tasks as one array.
BUCKETS = 1 << 14
#: An n-gram: up to three characters of a word.
GRAM = r"[^\x20\x09-\x0D]{1,3}"
#: Added to each bucket's count before taking probabilities, in the trusted documents by their share of the corpus.
SMOOTHING = 1.0
#: Mean log ratio (in nats) under which a document is rejected.
THRESHOLD = -0.6
#: Up to so many trusted ids (8 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 2_000_000

_WHITE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str, put: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def _split(text: Column) -> Column:
    """The words of a text, and some empty ones."""
    return F.split(_without(text, _WHITE[1:], " "), " ")


def _words(text: Column) -> Column:
    return F.array_remove(_split(text), "")


class Model(NamedTuple):
    """Weights of the n-grams of a text, one for each bucket."""

    weights: list[int]


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GRAM), F.lit(0))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def buckets_for(n_characters: int) -> int:
    """A power of two of at least four times the square root of the corpus' characters, as distinct n-grams grow about so."""
    from math import isqrt

    return max(BUCKETS, 1 << (4 * isqrt(n_characters)).bit_length())


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _window(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _meeting(words: Column, packed: Column, bits: Column) -> Column:
    """(hash, position), in order, of the windows whose part of the hash equals a neighbour's in `packed`.

    `packed` holds, in ascending order, one number per window: its position in the lowest `bits` bits and a part of
    its hash above them. Windows whose parts meet are few; their whole hashes decide.
    """
    same = lambda x, y: _right(x.bitwiseXOR(y), bits) == 0
    meet = F.filter(packed, lambda x, k: same(x, F.get(packed, k - 1)) | same(x, F.get(packed, k + 1)))
    place = lambda x: (x - _left(_right(x, bits), bits)).cast("int")
    return F.sort_array(F.transform(meet, lambda x: F.struct(_window(words, place(x)).alias("h"), place(x).alias("i"))))


def _covered(whole: Column) -> Column:
    """Number of words in the windows of `whole` (hash, position; in order) that share their hash with a neighbour."""
    twice = F.filter(whole, lambda x, k: F.coalesce(F.get(whole, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(whole, k + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input columns, and a struct `measures` with the words and the counts of each text."""
    text, words, hashes, bits, packed, whole = (free_name(docs, n) for n in ("q_text", "q_words", "q_hashes", "q_bits", "q_packed", "q_whole"))
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(words, _words(F.col(text)))
    w, t, b = F.col(words), F.col(text), F.col(bits)
    out = out.withColumn(bits, F.length(F.bin(F.size(w))))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: _window(w, i))
    none, h = F.array().cast("array<bigint>"), F.col(hashes)
    out = out.withColumn(hashes, F.when(F.size(w) >= 3, windows).otherwise(none))
    # Most texts repeat no window; the others' windows are put in order.
    inorder = F.sort_array(F.transform(h, lambda x, i: _left(_right(x, b), b) + i))
    out = out.withColumn(packed, F.when(F.size(F.array_distinct(h)) < F.size(h), inorder).otherwise(none))
    out = out.withColumn(whole, _meeting(w, F.col(packed), b))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(_without(t, _WHITE)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col(whole)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn(free_name(docs, "measures"), counts).drop(text, words, hashes, bits, packed, whole)


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, trusted_col: str) -> DataFrame:
    """(text, good) of each document."""
    ids = trusted.select(F.col(trusted_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(ids.withColumn("good", F.lit(True)), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))


def fit_model(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_col: str = "doc_id") -> Model:
    """Log ratio of each bucket in millionths of a nat, from the n-grams of all documents' whole texts.

    `trusted` lists the ids of the target documents. The trusted counts are smoothed by their share of the corpus, so
    what neither has weighs nothing, and what is rare in both hardly anything. Counting is one pass, after one that sums
    up lengths, and sums in every task before the shuffle; what comes back has one row per bucket. Without any trusted
    text all weights are 0.
    """
    n = buckets_for(docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0)
    texts = _marked(docs, trusted, id_col, text_col, trusted_col)
    grams = texts.select("good", F.explode(_grams(F.col("text"))).alias("gram"))
    counts = grams.groupBy(_bucket(F.col("gram"), n).alias("bucket")).agg(F.count("*").alias("all"), F.count_if("good").alias("good"))
    return Model(ratios_of({r["bucket"]: (r["all"], r["good"]) for r in counts.collect()}, n))


def ratios_of(counts: dict[int, tuple[int, int]], buckets: int) -> list[int]:
    """Log ratios of (corpus, trusted) counts per bucket, smoothed in proportion, as whole millionths."""
    from math import log

    corpus, trusted = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not trusted:
        return [0] * buckets
    share = trusted / corpus
    out = [0] * buckets
    for b, (a, t) in counts.items():
        out[b] = round(1e6 * log((t + SMOOTHING * share) / (share * (a + SMOOTHING))))
    return out


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Adds counts, `score` (mean log ratio, null without words), `base_failed` and `kept` to the input columns.

    `base_failed`: fewer than 50 words, or more than half of the words inside repeated three-word windows. Null and
    empty texts have no words, so they fail. Words of any length and texts of any length are taken whole; repeated
    rows are judged alike. A name that the input already has gets underscores. To filter by the verdict, use `passing`.
    """
    held, grams = free_name(docs, "measures"), free_name(docs, "q_grams")
    weights = F.from_json(F.lit(json.dumps(model.weights, separators=(",", ":"))), "array<int>")
    out = measures(docs, text_col).withColumn(grams, _grams(F.col(text_col).cast("string")))
    m, g = F.col(held), F.col(grams)
    total = F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + F.get(weights, _bucket(x, len(model.weights))))
    mean = F.when(m["n_words"] > 0, total / F.size(g) / 1e6)
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        out = out.withColumn(free_name(docs, name), m[name])
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    score = free_name(docs, "score")
    out = out.withColumn(score, mean).withColumn(free_name(docs, "base_failed"), failed)
    return out.withColumn(free_name(docs, "kept"), ~failed & (F.coalesce(F.col(score), F.lit(0.0)) >= threshold)).drop(held, grams)


def passing(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that `judge` keeps; same columns.

    A filter on computed columns is moved below the steps that compute them, and their expressions are then copied
    into the functions of single words. A row number, which may not be computed twice, holds the filter in place.
    """
    judged = judge(docs, model, threshold, text_col)
    kept, row = judged.columns[-1], free_name(judged, "q_row")
    numbered = judged.select(*docs.columns, F.col(kept), F.monotonically_increasing_id().alias(row))
    return numbered.filter(F.col(kept) & (F.col(row) >= 0)).select(*docs.columns)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select("doc_id")
