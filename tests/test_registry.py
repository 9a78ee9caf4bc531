"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks import oracle, queries as registered
from checks.compare import differences, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_query_has_sql():
    assert registered.queries().keys() == oracle.oracle_sql().keys()
    assert registered.queries().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, small, con, name):
    assert differences(spark, small, con, registered.queries()[name], oracle.oracle_sql()[name]) is None


def test_entry(spark):
    row = contract.entry(spark).first()
    assert 0 <= row.accuracy <= 1 and 0 <= row.auc <= 1
