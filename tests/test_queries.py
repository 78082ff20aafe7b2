"""Every registered query next to its SQL on the smallest tables."""

import pytest

from check_queries import compare, connect
from fieldtrace.catalog import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    ok, message, rows, _ = compare(spark, con, all_queries()[name], SF)
    assert ok, message


def test_entry_points():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inventory_is_covered():
    covered = {c for q in all_queries().values() for c in q.covers}
    ids = [f"{k}{i}" for k, n in (("S", 7), ("P", 28), ("J", 23), ("A", 15), ("W", 13), ("O", 4), ("U", 5), ("F", 21),
                                  ("G", 11), ("M", 13), ("D", 8)) for i in range(1, n + 1)]
    assert [i for i in ids if i not in covered] == []
