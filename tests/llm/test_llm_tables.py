"""Shards, perspectives and the pipeline."""

from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline
from turnstile.llm import chat, sharding

DOCS = "doc_id long, text string, shard string"


# --- shards


def _sizes(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.shard_].append(r.n_bytes)
    return found


@pytest.mark.parametrize("limit", [10, 50, 1000, 10**9])
def test_every_shard_fits_and_splits_only_where_needed(spark, limit):
    rows = [(i, "x" * (i % 10), "s") for i in range(300)] + [(None, None, None)]
    out = sharding.shard(spark.createDataFrame(rows, DOCS), limit)
    assert out.columns == ["doc_id", "text", "shard", "n_bytes", "depth", "shard_", "shard_bytes"]
    found = out.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((i, t) for i, t, _ in rows)
    sizes = _sizes(found)
    for name, parts in sizes.items():
        assert sum(parts) <= limit
        assert all(r.shard_bytes == sum(parts) and r.depth == len(name) for r in found if r.shard_ == name)
        if name:  # the parent would not fit
            assert sum(sum(p) for n, p in sizes.items() if n.startswith(name[:-1])) > limit


def test_a_hot_key_is_cut_into_pages(spark):
    rows = [(7, "y" * 9, None)] * 50 + [(8, "z" * 40, None), (9, "", None)]
    found = sharding.shard(spark.createDataFrame(rows, DOCS), 30).collect()
    sizes = _sizes(found)
    assert len(found) == 52 and sorted(sum(p) for p in sizes.values())[-1] == 40
    assert all(sum(p) <= 30 for p in sizes.values() if 40 not in p)
    assert any("-" in n for n in sizes)


def test_shards_of_no_rows(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS), 10).isEmpty()


# --- perspectives


def by_hand(turns, part_turns):
    """{(conversation, perspective): (text, mask)} of (conv, turn, role, text) rows."""
    talks = defaultdict(list)
    for conv, turn, role, text in turns:
        talks[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = {}
    for conv, said in talks.items():
        for who in {r for _, _, r, _ in said} - {"system"}:
            text, mask = "", []
            for _, _, role, body in sorted(said):
                text += f"<|im_start|>{'system' if role == 'system' else 'assistant' if role == who else 'user name=' + role}\n"
                start = len(text)
                text += body + "<|im_end|>"
                if role == who:
                    mask.append((start, len(text)))
                text += "\n"
            out[conv, who] = (text, mask)
    return out


def test_rotation_equals_rendering_by_hand(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 4)
    monkeypatch.setattr(chat, "BLOCK", 3)
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "cy", "x\ny"), (1, None, "ann", "early"), (2, 5, None, "solo"), (None, 0, "ann", "lost"), (3, 0, "system", "alone")]
    turns += [(4, i, "ann" if i % 2 else "bob", f"turn {i} " * (i % 5)) for i in range(30)]
    frame = spark.createDataFrame([(*t, "s") for t in turns], "conv_id long, turn long, role string, text string, perspective string")
    found = defaultdict(list)
    for r in chat.rotate(frame).collect():
        found[r.conv_id, r.perspective].append(r)
    rendered = {}
    for key, parts in found.items():
        parts.sort(key=lambda r: r.part)
        assert all(r.n_turns <= 4 for r in parts)
        assert [r.part_start for r in parts] == [sum(len(p.text) for p in parts[:i]) for i in range(len(parts))]
        rendered[key] = ("".join(r.text for r in parts), [tuple(s) for r in parts for s in r.mask])
    assert rendered == by_hand(turns, 4)


def test_no_turns(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


# --- pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    good = [" ".join(f"w{(i * 31 + j * j * 7) % 500}ing" for j in range(120)) for i in range(30)]
    passage = " ".join(f"bench{j}" for j in range(15))
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[0], "en", "src", 1), (100, good[0], "en", "src", 1), (101, good[1] + " more", None, "src", 1), (102, good[2].replace("w", "v") + " " + passage + " end", "en", None, 1), (103, " ".join(f"X{j}!!" for j in range(90)), "en", "src", 1)]
    rows += [(104, "short", "en", "src", 1), (105, None, "en", "src", None), (106, "", "en", "src", 0), (107, good[3].replace("w", "u") + " mail ann@site.org now", "en", "src", 1), (None, good[4].replace("w", "t"), "en", "src", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(103, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_keep_the_columns_and_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "personal_data", "tokens"]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    first, second, third, last = texts.values()
    assert set(first) == {*range(30), 100, 101, 102, 107, None}
    groups = brute.components([(i, t) for i, t in first.items() if i is not None], 5, 80)
    assert set(second) == {i for i, (_, root) in groups.items() if i == root} | {None}
    assert 100 not in second and 101 not in second
    assert "bench7" in second[102] and "bench" not in third[102] and third[102].endswith("end")
    assert "ann@site.org" in third[107] and "<EMAIL> now" in last[107]
    assert all(last[i] == first[i] for i in range(30))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(last) and all(r.lossless for r in rows)


def test_an_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).isEmpty()
