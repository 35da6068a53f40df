"""Registered queries against their SQL on the smallest tables."""

import pytest

import oracle
from docrecon.catalog import QUERIES, SQL

SF_DIR = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    problem = oracle.difference(name, QUERIES[name](spark, SF_DIR), con, SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"reconcile_audit", "reconcile_responses"}))
def test_runs(spark, name):
    assert not QUERIES[name](spark, SF_DIR).isEmpty()
