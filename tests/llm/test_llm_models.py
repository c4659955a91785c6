"""Fill-in-the-middle, alignment of two tokenizers and the quality classifier, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from turnstile.llm import align, boosting, fim
from turnstile.llm.common import strings

DOCS = "doc_id long, text string, n string, form string"
SMALL = "/root/testdata/sf0.001"
LONG = "wörd <x " * 30_000

# --- fill in the middle

texts_ = st.lists(st.text(alphabet="ab é漢\U0001f600\n", max_size=60), max_size=12)


@settings(max_examples=60, deadline=None)
@given(texts_, st.sampled_from([None, r"\w+", r"\n"]), st.data())
def test_a_descent_ends_on_its_rank(texts, pattern, data):
    unit = re.compile(pattern) if pattern else None
    listed, raw, bounds = fim.skip_list(strings(pa.array(texts, pa.string())), unit)
    starts = [list(range(len(t))) if unit is None else sorted({0} | {m.start() for m in unit.finditer(t)}) if t else [] for t in texts]
    assert listed.counts.tolist() == [len(s) for s in starts]
    ranks = [data.draw(st.integers(0, len(s))) for s in starts]
    chars, size = listed.before(np.arange(len(texts)), np.asarray(ranks, np.int64))
    for k, (text, at, rank) in enumerate(zip(texts, starts, ranks)):
        wanted = [*at, len(text)][rank] if text else 0
        assert chars[k] == wanted and size[k] == len(text[:wanted].encode())
        assert raw[bounds[k] : bounds[k] + size[k]].decode() == text[:wanted]


def test_lanes_shrink_and_carry_what_they_span():
    listed, _, _ = fim.skip_list(strings(pa.array(["é" * 5000, "", "x", "y" * 3])))
    assert len(listed.lanes) > 3 and len(listed.lanes[-1].units) == 3
    for lane in listed.lanes:
        assert lane.units.sum() == lane.chars.sum() == 5004 and lane.bytes.sum() == 10004
    assert all(len(a.units) > len(b.units) for a, b in zip(listed.lanes, listed.lanes[1:]))


def _middle(doc_id, text):
    """(n, form, prefix, middle, output) by hand."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_outputs_equal_cutting_by_hand_and_give_the_text_back(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aé漢\U0001f600 <PSM>\n", k=rng.randint(0, 40))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "a<P>b"), (903, LONG), (None, "no id"), (5, "again"), (5, "again"), (904, "<P"), (905, ">")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    out = fim.fill_in_middle(frame)
    assert out.columns == [*frame.columns, "n_", "form_", "prefix_chars", "middle_chars", "output"]
    found = Counter((r.doc_id, r.text, r.n, r.n_, r.form_, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert found == Counter((i, t, "x", *_middle(i, t)) for i, t in rows)
    back = out.select("text", fim.restored(out["form_"], out["output"]).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert {r.form_ for r in out.collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame.limit(0)).isEmpty()


def test_cuts_between_words_give_the_text_back(spark):
    frame = spark.createDataFrame([(i, f"one two  three\nfour {i} ", None, None) for i in range(40)] + [(50, "  ", None, None)], DOCS)
    out = fim.fill_in_middle(frame, unit=r"\S+", cut_percent=100)
    for r in out.select("*", fim.restored(out["form_"], out["output"]).alias("back")).collect():
        assert r.back == r.text and r.n_ == len(r.text.split() or [0])
        assert r.text[: r.prefix_chars] == "" or r.prefix_chars == len(r.text) or r.text[r.prefix_chars - 1].isspace()


# --- alignment


@pytest.fixture(scope="module")
def files():
    return Path(align.FILE_A).read_bytes(), Path(align.FILE_B).read_bytes()


@pytest.fixture(scope="module")
def pair(files):
    return align.Pair(*files)


@pytest.fixture(scope="module")
def tokenizers_a(files):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(files[0].decode())
    slow.encode_special_tokens = True
    return slow


def test_every_character_is_cut_alike_by_both_libraries(pair, tokenizers_a):
    codes = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 53)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c} {c}{c} \n{c}'s" for c in map(chr, codes)] + ["x <|endoftext|> y", " " * 999, "ab" * 9999]
    slow = [e.ids for e in tokenizers_a.encode_batch(texts, add_special_tokens=False)]
    assert pair.sides[0].encode(texts) == slow


def _ends(ids, raw):
    return np.cumsum([len(raw[i]) for i in ids]).tolist()


def by_hand(pair, slow, rows):
    """The rows of `summaries`, from both libraries' own tokens and sets of ends."""
    spelled, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a, b = slow.encode(" " + text, add_special_tokens=False).ids, pair.sides[1].encode([text])[0]
        raw = [b"".join(side.raw[i] for i in ids) for side, ids in zip(pair.sides, (a, b))]
        if not text or raw[0] != raw[1] or raw[0] != (" " + text).encode():
            a, b = [], []
        ends = [_ends(ids, side.raw) for ids, side in zip((a, b), pair.sides)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in both]
        groups, last = [], [0, 0]
        for e in both:
            now = [x.index(e) + 1 for x in ends]
            groups.append(",".join(map(str, a[last[0] : now[0]])) + "|" + ",".join(map(str, b[last[1] : now[1]])))
            last = now
        counts.update(links)
        spelled.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (d, a, b, g, len(links), hashlib.sha256(s.encode()).hexdigest() if s else "", sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
        for d, a, b, g, links, s in spelled
    ]


EDGES = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "naïve 漢字 \U0001f600\n\nx  y"), (6, "<|endoftext|> <s> </s> <0x41>"), (None, "no id here"), (7, "again"), (7, "again"), (8, "a\0b\r\n\tc"), (9, "supercalifragilistic" * 40)]


def test_summaries_equal_sets_of_ends(spark, pair, tokenizers_a):
    known = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    rows = EDGES + known
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    out = align.summaries(frame)
    assert out.columns == columns
    assert Counter(map(tuple, out.select(columns).collect())) == Counter(by_hand(pair, tokenizers_a, rows))


def test_lanes_of_any_length_give_the_same_cuts(pair, monkeypatch):
    texts = ["", LONG[:5000], *(t or "" for _, t in EDGES), "zz " * 700]
    whole = pair.align(texts)
    for tokens in (1, 7, 10**9):
        monkeypatch.setattr(align, "LANE_TOKENS", tokens)
        assert all(np.array_equal(x, y) for x, y in zip(whole, pair.align(texts)))


def test_every_link_is_a_possible_pair(pair):
    x = pair.align([LONG[:9000], "Die Straße, l'été; ¿qué?"])
    n = len(pair.sides[1].raw)
    assert np.array_equal(pair.pairs[pair.links(x)], x.a[x.cut_a] * n + x.b[x.cut_b])


def test_aligned_tokens(spark, pair):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in EDGES], DOCS)
    for r in align.align(frame).collect():
        ends = [_ends(ids, side.raw) for ids, side in zip((r.a_ids, r.b_ids), pair.sides)]
        assert [ends[0][k] for k in r.a_cuts] == [ends[1][k] for k in r.b_cuts] == sorted(set(ends[0]) & set(ends[1]))
    assert align.align(frame.limit(0)).isEmpty() and align.summaries(frame.limit(0)).isEmpty()
    nothing = align.summaries(spark.createDataFrame([(1, None, "", "")], DOCS)).first()
    assert tuple(nothing)[1:] == (0, 0, 0, 0, "", 0, 0)


# --- classifier


def plain_statistics(text):
    """Some of the numbers, over ASCII texts."""
    w, lines = text.split(), [x for x in text.split("\n") if x]
    three = list(zip(w, w[1:], w[2:]))
    share = lambda x, y: x / max(y, 1)
    return {
        "chars": np.log1p(len(text)),
        "words": np.log1p(len(w)),
        "upper": share(sum(c.isupper() for c in text), len(text)),
        "symbols": share(sum(c in "#*$%&|<>" for c in text), len(text)),
        "word_length": share(sum(map(len, w)), len(w)),
        "word_spread": np.std([len(x) for x in w]) if w else 0,
        "shouted": share(sum(x.upper() == x and sum(c.isupper() for c in x) > 1 for x in w), len(w)),
        "different": share(len(set(w)), len(w)),
        "top_word": share(max(Counter(w).values(), default=0), len(w)),
        "doubled": share(sum(a == b for a, b in zip(w, w[1:])), len(w)),
        "runs": share(len(set(three)), len(three)),
        "line_repeats": 1 - share(len(set(lines)), len(lines)),
    }


def test_statistics_equal_counting_by_hand():
    rng = random.Random(5)
    texts = ["", "A", " \n ", "x " * 3000] + ["".join(rng.choices("abAB1 .!#|\n", k=rng.randint(0, 200))) for _ in range(120)]
    raw = [t.encode() for t in texts]
    got = boosting.measure(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for t, row in zip(texts, got):
        named = dict(zip(boosting.STATISTICS, row))
        for name, value in plain_statistics(t).items():
            if name == "line_repeats" and not [x for x in t.split("\n") if x]:
                continue
            assert named[name] == pytest.approx(value, abs=1e-6), (t, name)


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    label = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = boosting.grow(x, label, trees=25)
    for row, chance in zip(x[:80], forest.score(x)):
        total = forest.start
        for t in range(len(forest.asked)):
            node = 0
            while forest.left[t, node] != node:
                node = (forest.left if row[forest.asked[t, node]] <= forest.cut[t, node] else forest.right)[t, node]
            total += forest.value[t, node]
        assert chance == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.score(x) >= 0.5) == label).mean() > 0.95


def test_a_cut_is_the_best_of_all_cuts():
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=(3, boosting.BINS)), rng.uniform(1, 2, size=(3, boosting.BINS))

    def gain(f, k):
        parts = [(g[f, : k + 1].sum(), h[f, : k + 1].sum()), (g[f, k + 1 :].sum(), h[f, k + 1 :].sum()), (g[f].sum(), h[f].sum())]
        left, right, whole = (a * a / (b + boosting.PENALTY) for a, b in parts)
        return left + right - whole

    best = max(gain(f, k) for f in range(3) for k in range(1, boosting.BINS - 2))
    assert boosting._best(g, h)[0] == pytest.approx(best)


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_labels_are_met_and_never_used(spark, tables):
    docs, labels = tables
    out = boosting.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in out if r.held_out and r.doc_id in known]
    assert len(held) > 90 and sum(r.predicted == known[r.doc_id] for r in held) >= 0.98 * len(held)
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality")
    assert sorted((r.doc_id, r.score) for r in boosting.classify(docs, flipped).collect()) == sorted((r.doc_id, r.score) for r in out)


def test_classifier_of_odd_rows(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "x"), (1, "a b c"), (4, LONG)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    labels = lambda found: spark.createDataFrame(found, "doc_id long, quality int")
    for found in ([], [(1, 1), (3, 1), (None, 0)], [(1, 1), (1, 0)], [(1, None)]):
        out = boosting.classify(docs, labels(found)).collect()
        assert len(out) == 6 and len({r.score for r in out}) == 1
    assert boosting.classify(docs.limit(0), labels([(1, 1)])).isEmpty()
    assert boosting.labels_of(labels([(1, 1), (1, 0), (1, 0), (2, 1), (2, 0), (3, 1)])).orderBy("doc_id").collect() == [(1, 0), (3, 1)]
