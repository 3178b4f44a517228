"""Every registered query against its SQL, at the smallest scale."""

import pytest

from tests.compare import database, differences
from workload.oracles import ORACLES
from workload.queries import QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 8
