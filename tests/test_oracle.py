"""Every registered query against its SQL twin on the small tables."""

import pytest
from compare import families, spark_rows, sql_connection, sql_rows
from conftest import SMALL

import __spark_entry__ as contract
from turnstile.plans import oracle, queries

_SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return sql_connection(SMALL)


def test_every_query_has_a_twin():
    assert set(queries.queries()) == set(_SQL)
    assert set(_SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(spark, connection, name):
    df = contract.queries()[name](spark, SMALL)
    ours = spark_rows(df)
    theirs = sql_rows(connection, _SQL[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    assert ours[1], "an empty result proves nothing"
    described = connection.execute(_SQL[name]).description
    assert families(df.dtypes) == families([(d[0], d[1]) for d in described])


def test_entry_is_lazy_and_not_empty(spark):
    assert contract.entry(spark).limit(1).count() == 1
