"""Every registered query against its SQL on another engine, over whole tables."""

import pytest
from compare import differences, oracle_connection
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from contractflow.checks.queries import QUERIES


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert differences(spark, oracle, name, SMALL, queries(), oracle_sql()) == []


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(QUERIES) <= set(queries())


def test_entry(spark):
    assert {r["status"] for r in entry(spark).collect()} == {"PASS", "QUARANTINE", "DUPLICATE"}
