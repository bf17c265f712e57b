"""Every registered query against its SQL on an embedded engine."""

from __future__ import annotations

import pytest
from samples import SAMPLE
from oracle import compare, connect

from reelshelf.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees(spark, con, name):
    problem = compare(spark, con, name, SAMPLE)
    # The smallest sample leaves some narrow queries without rows.
    assert problem in ("", "both empty", "no rows"), problem


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert entry.entry(spark).count() == 24
