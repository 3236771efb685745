"""Every registered query on the smallest tables, compared with DuckDB where it has a check."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.compare import DATA, check, duck

SF = os.environ.get("FLEETLENS_TEST_SF", "sf0.001")
QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problems, rows = check(spark, con, SF, name, QUERIES[name], CHECKS.get(name))
    assert not problems, problems
    assert rows >= 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert os.path.isdir(DATA)
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["wait_type", "rank"]
