"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from check import compare, connect
from rollmill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, problems = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    # A filter may rightly leave nothing of the smallest tables.
    assert [p for p in problems if p != "no rows"] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
