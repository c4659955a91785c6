"""Decontamination, personal data, quality rules and pieces on hand-made rows."""

import random

import brute
import pytest
from hypothesis import given, settings, strategies as st

from turnstile.llm import decontaminate, pieces, pii, quality

DOCS = "doc_id long, text string, spans string"
LONG = "word " * 60_000


def rows_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- decontamination


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "c d e f g h i j k l m"), (10, "x y"), (3, ""), (4, None), (None, "q"), (5, "J K L M N O P Q R S"), (6, "x y")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 12])
def test_overlaps_equal_all_windows(spark, block_bytes):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefghijklmxy", k=rng.randint(0, 30))) for _ in range(40)]
    texts += ["Z a b C d-e f g h i j k l m n o p q r s z", "x", "x y x y", "abcdefghij", "", None, LONG + "a b c d e f g h i j", "é x  y é"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "x y", "s"), (0, "x y", "s")]
    found = decontaminate.overlaps(rows_of(spark, rows), _items(spark, ITEMS), block_bytes=block_bytes).collect()
    expected = []
    for doc_id, text, _ in rows:
        n, hit, items = brute.benchmark_hits(text, ITEMS)
        expected.append((doc_id, n, len(hit), len(items), brute.sha256(",".join(sorted(str(i) for i in items if i is not None))), bool(hit)))
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)


def test_items_have_ids_of_any_kind(spark):
    items = spark.createDataFrame([("q-10", "a b"), ("q-9", "b c"), (None, "z z"), (None, "y")], "item_id string, text string")
    found = decontaminate.overlaps(rows_of(spark, [(1, "a b c z z y", None), (2, "y", None), (3, "c", None)]), items)
    rows = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    assert rows[1] == (6, 3, brute.sha256("q-10,q-9"), True) and rows[2] == (1, 1, brute.sha256(""), True) and rows[3][0] == 0
    cut = decontaminate.decontaminate(rows_of(spark, [(1, "u v w x z z t s r q", None)]), items)
    assert cut.first().text.split() == "u v w x t s r q".split()


def test_overlaps_of_empty_tables(spark):
    one = rows_of(spark, [(1, "a b", None)])
    assert decontaminate.overlaps(one, _items(spark, [])).collect()[0].contaminated is False
    assert decontaminate.overlaps(rows_of(spark, []), _items(spark, ITEMS)).isEmpty()
    assert decontaminate.decontaminate(rows_of(spark, []), _items(spark, ITEMS)).isEmpty()


def test_passages_are_cut_and_clean_documents_stay(spark):
    passage = "A b, c d e f g h i j k l!"
    clean = "nothing here: " + "w " * 30
    rows = [(1, clean + passage + " tail", "s"), (2, clean, None), (3, passage, "s"), (4, None, None), (5, "", None), (6, "u a b c d x y e f g h i j k l u " + clean, None)]
    docs = rows_of(spark, rows)
    out = decontaminate.decontaminate(docs, _items(spark, ITEMS))
    assert out.schema == docs.schema
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == {1, 2, 4, 5, 6} and kept[2] == clean and kept[4] is None and kept[5] == ""
    assert kept[1].split() == (clean + " ! tail").split()
    # Cutting "x y" joins a passage, which is then cut too.
    assert kept[6].split() == ("u u " + clean).split()


def test_cuts_do_not_depend_on_blocks(spark):
    items = [(1, "a b c d e f g h i j"), (2, "h i j k l m n o p q"), (3, "x y"), (4, "r s t u v w")]
    clean = " ".join(["fine"] * 40)
    texts = [
        "a b c d e f g h i j " + "z " * 14 + "r s t u v w r s t u v w",  # over half only with both
        clean + " a b c d e f g h i j k l m n o p q " + clean,  # overlapping
        clean + " a b c d x y e f g h i j " + clean,  # joined by the cut of another item
        clean + " r s t a b c d e f g h i j u v x y w " + clean,  # joined by two
        clean, "", None, "x y", "x y",
    ]
    docs = rows_of(spark, [(i % 5, t, "s") for i, t in enumerate(texts)] + [(None, "x y " + clean, None)])
    order = lambda r: tuple(map(str, r))
    for limits in ({}, {"max_words": 6}, {"max_share": 0.2}):
        one, several = (sorted(map(tuple, decontaminate.decontaminate(docs, _items(spark, items), block_bytes=b, **limits).collect()), key=order) for b in (1 << 20, 12))
        assert one == several and one
    kept = [r.text for r in decontaminate.decontaminate(docs, _items(spark, items), block_bytes=12).collect() if r.text]
    assert len(kept) == 5 and {w for t in kept for w in t.split()} == {"fine"}


# --- personal data


def test_spelled_digits_may_stand_far_apart(spark):
    gap = "   -     "
    text = "card " + gap.join("four one one one one one one one one one one one one one one one".split()) + " end"
    row = pii.find_pii(rows_of(spark, [(1, text, None)])).first()
    kinds = [s.split(":")[0] for s in row[[c for c in row.asDict() if c.startswith("spans")][-1]].split(",") if s]
    assert "card" in kinds


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john dot doe at mail dot example dot com now", "email", "john dot doe at mail dot example dot com"),
        ("see me (at) site.org!", "email", "me (at) site.org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"),
        ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("a​b@c.de", "email", "a​b@c.de"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    _, spans = pii.find(text)
    assert (text.index(found), text.index(found) + len(found), kind) in spans


@pytest.mark.parametrize("text", ["look at me", "one two", "at the end. dot the i", "version 1.2.3", "1 2 3", "we meet at noon dot", ""])
def test_clean_texts_have_no_spans(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("call +49 three 0 five 5 one 2 seven 8 four 6 now", "phone", "+49 three 0 five 5 one 2 seven 8 four 6"),
        ("card 4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one.", "card", "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"),
        ("write to jane.doe at example.com today", "email", "jane.doe at example.com"),
        ("write to jane7 at example.co.uk today", "email", "jane7 at example.co.uk"),
        ("to a dot b dot c dot d dot e dot f at x dot org", "email", "a dot b dot c dot d dot e dot f at x dot org"),
        ("to " + "long.name" * 40 + " (at) x.org", "email", "long.name" * 40 + " (at) x.org"),
    ],
)
def test_mixed_bare_and_long_disguises_are_found_whole(text, kind, found):
    assert pii.find(text)[1] == [(text.index(found), text.index(found) + len(found), kind)]


@pytest.mark.parametrize("text", ["we met at example.com", "since 2010 at example.com", "see p.5 at Section.Then", "one 2 three", "un 5 six"])
def test_words_that_only_look_disguised(text):
    assert pii.find(text) == ([], [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.+-() 0123456789%", max_size=60))
def test_base_spans_equal_the_expressions(text):
    base, spans = pii.find(text)
    assert pii._joined(base) == brute.base_spans(text)
    assert set(base) <= set(spans)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" + "(" * 200_000, "one " * 60_000, " at " * 60_000, "[at]" * 50_000):
        pii.find(text)


def test_report_and_redaction(spark):
    rows = [(1, "a@b.com 1.2.3.4", "kept"), (1, "a@b.com 1.2.3.4", "kept"), (2, None, None), (3, "", None), (None, "x (at) y.com", "s"), (4, LONG, None)]
    docs = rows_of(spark, rows)
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert (found[1].spans, found[1].n_email, found[1].n_ip) == ("email:0:7,ip:8:15", 1, 1)
    assert (found[None].n_email, found[None].spans, found[2].spans) == (0, "email:0:12", "")
    out = pii.redact_pii(docs)
    assert out.schema == docs.schema
    assert [r.text for r in out.collect()][:5] == ["<EMAIL> <IP>", "<EMAIL> <IP>", None, "", "<EMAIL>"]
    assert pii.find_pii(rows_of(spark, [])).isEmpty()


# --- quality rules


def test_quality_edges_and_clashing_names(spark):
    loop = "again and again " * 40
    rows = [(1, "good words here " + " ".join(f"a{i}ing" for i in range(60)), "k"), (2, None, "k"), (3, "", None), (4, loop, None), (5, "!! ".join(f"X{i}!!" for i in range(80)), None), (5, LONG, None), (None, loop, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumnRenamed("kept", "N_WORDS")
    model = quality.fit_model(docs, spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long"))
    out = quality.judge(docs, model)
    assert out.columns == ["doc_id", "text", "N_WORDS", "n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    found = out.collect()
    for r in found:
        assert (r.n_words_, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.counts(r.text)
    verdicts = {(r.doc_id, r.n_words_): r.kept for r in found}
    assert verdicts[1, 63] and not verdicts[2, 0] and not verdicts[4, 120] and not verdicts[5, 80]


def test_quality_without_trusted_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long")
    docs = rows_of(spark, [(1, " ".join(f"w{i}" for i in range(60)), None)])
    model = quality.fit_model(docs, none)
    assert set(model.weights) == {0} and quality.judge(docs, model).first().kept
    empty = rows_of(spark, [])
    assert quality.judge(empty, quality.fit_model(empty, none)).isEmpty()


def pieces_of(text):
    """The n-grams of a text: every word cut into threes."""
    return [w[i : i + 3] for w in (text or "").split() for i in range(0, len(w), 3)]


def test_weights_equal_counting_by_hand(spark):
    texts = {1: "thing running fast", 2: "xx!! yy!! running", 3: None, 4: " "}
    docs = rows_of(spark, [(i, t, None) for i, t in texts.items()])
    model = quality.fit_model(docs, spark.createDataFrame([(1,)], "doc_id long"))
    from pyspark.sql import functions as F

    grams = spark.createDataFrame([(i, g) for i, t in texts.items() for g in pieces_of(t)], "i int, g string")
    counts: dict[int, list[int]] = {}
    for r in grams.select("i", F.expr(f"pmod(xxhash64(g), {quality.BUCKETS})").cast("int").alias("b")).collect():
        counts.setdefault(r.b, [0, 0])[0] += 1
        counts[r.b][1] += r.i == 1
    assert model.weights == quality.ratios_of({b: tuple(c) for b, c in counts.items()}, quality.BUCKETS)


def test_every_part_of_a_word_is_scored(spark):
    import math

    rng = random.Random(3)
    stems = [a + b for a in ("wo", "re", "ta", "pla", "sto", "mi") for b in ("rk", "ad", "lk", "nt", "ck", "ll")]
    good = [" ".join(rng.choice(stems) + "ing" for _ in range(80)) for _ in range(6)]
    made_up = " ".join("".join(rng.choices("qxzvjk", k=5)) + "ing" for _ in range(80))
    texts = [*good, made_up, "", None]
    docs = rows_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    model = quality.fit_model(docs, spark.createDataFrame([(i,) for i in range(5)], "doc_id long"))
    found = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert found[5].kept and not found[6].kept and not found[6].base_failed and found[7].score is None is found[8].score
    # The score by hand: buckets are many, so a clash would be rare.
    grams, k = pieces_of, quality.SMOOTHING
    corpus, trusted = [g for t in texts for g in grams(t)], [g for t in texts[:5] for g in grams(t)]
    share = len(trusted) / len(corpus)
    weigh = lambda g: math.log((trusted.count(g) + k * share) / (share * (corpus.count(g) + k)))
    assert abs(found[5].score - sum(map(weigh, grams(good[5]))) / len(grams(good[5]))) < 0.02
    assert [r.doc_id for r in quality.passing(docs, model).collect()] == list(range(6))
    assert quality.buckets_for(10**10) > quality.buckets_for(10**8) > quality.buckets_for(0) == quality.BUCKETS


# --- pieces


def test_models_of_one_size_and_end_do_not_share_a_codec():
    class Held:
        def __init__(self, pieces_):
            import hashlib

            self.value = pieces.Vocabulary(hashlib.sha256(repr(pieces_).encode()).hexdigest(), pieces_)

    tail = [(f"x{i}", -float(i), False) for i in range(300)]
    first, second = (pieces._codec(Held([(a, 0.0, False), (b, -1.0, False), *tail]), 0, 0.0) for a, b in (("p", "q"), ("q", "p")))
    assert first.encode("p").tolist() != second.encode("p").tolist()


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_pieces()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_losslessly(text):
    codec = test_any_text_is_encoded_losslessly.codec
    assert codec.decode(codec.encode(text).tolist()) == text


test_any_text_is_encoded_losslessly.codec = pieces.Codec(pieces.read_pieces(), 3, 0.3)


def test_without_dropout_it_is_the_library_s_encoding(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    codec = pieces.Codec(vocabulary, 1, 0.0)
    for text in ["Hello  world", " a", "a\nb\tc", "é ﬁ Ａ 漢字 😀", "a  ", "", "supercalifragilisticexpialidocious " * 3, "x" * 300]:
        assert codec.encode(text).tolist() == library.encode(text)


def test_seeds_vary_and_repeat(vocabulary):
    text = "the quick brown fox jumps over the lazy dog " * 20
    ids = {seed: pieces.Codec(vocabulary, seed, 0.2).encode(text).tolist() for seed in (1, 2)}
    assert ids[1] != ids[2] and ids[1] == pieces.Codec(vocabulary, 1, 0.2).encode(text).tolist()
    assert len(ids[1]) > len(pieces.Codec(vocabulary, 1, 0.0).encode(text))


def _units(text):
    """The characters of the escaped text's units, a mark of the text itself as a surrogate."""
    import re

    escaped = "▁" + text.replace("▁", "\ud800").replace(" ", "▁")
    return [list(u) for u in re.findall("\n|▁+[^▁\n]*|[^▁\n]+", escaped)]


def _by_heap(codec, text):
    """Ids of a text whose units are merged one by one, each with a heap under its own key."""
    units, out = _units(text) if text else [], []
    for unit, key in zip(units, codec._keys(text, len(units)).tolist(), strict=True):
        at = 0
        for size in codec._agenda(unit, key):
            if size:
                part = "".join(unit[at : at + size])
                number = codec.known.get(part, -1)
                raw = part.replace("\ud800", "▁").encode("utf-8", "surrogatepass")
                out += [number] if 0 <= number < codec.n_pieces else codec.bytes[list(raw)].tolist()
            at += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="etaoinshrd ▁é漢\n\t\ufffd", max_size=120), max_size=6), st.sampled_from([0.0, 0.1, 0.5, 0.999]))
def test_merging_in_step_equals_a_heap_for_each_unit(texts, dropout):
    codec = pieces.Codec(test_merging_in_step_equals_a_heap_for_each_unit.vocabulary, 5, dropout)
    assert [x.tolist() for x in codec.encode_all(texts)] == [_by_heap(codec, t) for t in texts]


test_merging_in_step_equals_a_heap_for_each_unit.vocabulary = [v for v in pieces.read_pieces() if v[2] or len(v[0]) < 4 or v[0].strip("▁etaoinshrd") == ""]


def test_each_occurrence_draws_its_own_skips(vocabulary):
    codec, plain = pieces.Codec(vocabulary, 7, 0.1), pieces.Codec(vocabulary, 7, 0.0)
    text = " ".join(["information", "representation"] * 3000)
    units = _units(text)
    keys = codec._keys(text, len(units))
    assert codec.encode(text).tolist() == _by_heap(codec, text)
    for word in ("▁information", "▁representation"):
        mine = [int(k) for u, k in zip(units, keys, strict=True) if u == list(word)]
        codes = []
        plain._agenda(list(word), 0, codes)
        assert len({tuple(codec._agenda(list(word), k)) for k in mine}) > 30
        # No candidate is skipped as often as independent draws of one in ten would have it.
        untouched = sum(not any((k ^ c) * pieces._D % 2**64 >> 32 < codec.limit for c in codes) for k in mine)
        assert abs(untouched / len(mine) - 0.9 ** len(codes)) < 0.04


def test_company_and_long_units_change_nothing(vocabulary, monkeypatch):
    text = "some words recur and some words do not, some are " + "verylong" * 40
    texts = [text * 3, "", text, "\n\n a", "▁"]
    codec = pieces.Codec(vocabulary, 7, 0.3)
    alone = [codec.encode(t).tolist() for t in texts]
    assert alone == [_by_heap(codec, t) for t in texts]
    monkeypatch.setattr(pieces, "TOGETHER", 3)
    assert [ids.tolist() for ids in codec.encode_all(texts)] == alone


def test_tables_of_pieces(spark):
    rows = [(1, "Hello  ▁world", "s"), (1, "Hello  ▁world", "s"), (2, None, None), (3, "", None), (None, LONG, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = pieces.encode(docs)
    found = out.collect()
    assert all(r.lossless for r in found) and [r.n_tokens for r in found][2:4] == [0, 0] and found[0] == found[1]
    assert sorted((r.doc_id or 0, r.text) for r in pieces.decode(out).collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert pieces.encode(docs.limit(0)).isEmpty()
