"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from driver_queries import registered
from oracle import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_of_the_library_has_sql():
    assert set(registered()) <= set(entry.oracle_sql()) <= set(entry.queries())


# Queries for training data that SQL can't express are tested in tests/llm.
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    assert difference(con, frame, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["log_level", "count"]


def test_results_are_not_empty(con):
    """An oracle that returns nothing proves nothing."""
    empty_by_nature = {"quota_violations", "malformed_names"}
    for name, sql in entry.oracle_sql().items():
        if name not in empty_by_nature:
            assert con.execute(sql).fetchall(), name
