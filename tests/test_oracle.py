"""Every query against its SQL, whole results."""

from __future__ import annotations

import pytest
from compare import compare, database

import __spark_entry__ as entry
from orderloom.plans.oracles import ORACLES
from orderloom.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert not entry.entry(spark).isEmpty()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name]) == []
