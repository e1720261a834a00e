"""Every registered query at the smallest scale; those with an oracle must equal it exactly."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

_QUERIES, _SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_contract(spark):
    assert set(_SQL) <= set(_QUERIES)
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(_QUERIES))
def test_query(spark, duck, folder, name):
    message, _ = compare(spark, duck, folder, name, _QUERIES[name], _SQL.get(name))
    assert message is None, message
