"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracles import connect, oracle_rows, spark_rows

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


OWN = [query.__name__ for query in entry._QUERIES]


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    got = spark_rows(entry.queries()[name](spark, SF))
    want = oracle_rows(duck, entry.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
