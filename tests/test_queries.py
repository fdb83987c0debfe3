"""Every registered query against its DuckDB SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from scrubline.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    assert compare(spark, duck, FOLDER, QUERIES[name], ORACLES.get(name)) is None


def test_entry_has_all():
    assert set(QUERIES) <= set(entry.queries())
    assert {k: entry.oracle_sql()[k] for k in ORACLES} == ORACLES


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["issue_score"] for r in rows] == sorted((r["issue_score"] for r in rows), reverse=True)
    assert len(rows) == 11
