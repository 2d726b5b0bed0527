"""Every registered query against its oracle SQL."""

from __future__ import annotations

import functools

import pytest

import __spark_entry__ as entry
from workload import queries
from workload.check import compare, oracle_connection
from workload.oracles import ORACLES
from workload.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def one_fit():
    """Queries that train on the same rows share one fit."""
    real = queries.trained
    queries.trained = functools.lru_cache(maxsize=1)(real)
    yield
    queries.trained = real


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    if name in ORACLES:
        assert compare(spark, oracle, SMALL, QUERIES[name], ORACLES[name]) == ""
    else:
        assert QUERIES[name](spark, SMALL).take(1)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 2
