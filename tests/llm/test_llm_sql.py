"""Registered queries of the package against their SQL, and against brute force where SQL can't say it."""

import brute
import pytest
from compare import families, spark_rows, sql_connection, sql_rows

from turnstile.llm import quality
from turnstile.llm import queries as registry

SMALL = "/root/testdata/sf0.001"
_SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return sql_connection(SMALL)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(spark, connection, name):
    df = registry.queries()[name](spark, SMALL)
    ours, theirs = spark_rows(df), sql_rows(connection, _SQL[name])
    assert ours == theirs
    assert families(df.dtypes) == families([(d[0], d[1]) for d in connection.execute(_SQL[name]).description])


@pytest.fixture(scope="module")
def documents(connection):
    return dict(connection.execute("SELECT doc_id, text FROM documents").fetchall())


def test_personal_data_has_the_base_spans(spark, documents):
    rows = registry.op1_pii(spark, SMALL).collect()
    assert {r.doc_id: r.base_sha256 for r in rows} == {d: brute.sha256(brute.base_spans(t)) for d, t in documents.items()}


def test_quality_counts(spark, documents):
    rows = registry.op3_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n = brute.counts(documents[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_tokens_decode_to_the_texts(spark, documents):
    rows = registry.op6_merge_dropout(spark, SMALL)
    from turnstile.llm import pieces

    assert rows.filter("NOT lossless").isEmpty()
    assert {r.doc_id: r.text for r in pieces.decode(rows).collect()} == {d: t or "" for d, t in documents.items()}


def test_every_page_has_a_text_and_a_verdict(spark, connection):
    (n,) = connection.execute("SELECT count(*) FROM pages").fetchone()
    assert registry.op5_tag_path_text(spark, SMALL).filter("n_chars > 0").count() == n
    judged = registry.op8_url_filter(spark, SMALL)
    assert judged.count() == n and judged.filter("verdict NOT IN ('allow', 'block')").isEmpty()
