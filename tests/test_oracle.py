"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, folder, name):
    problems, rows, _, _ = differences(spark, duck, folder, name, QUERIES, ORACLES)
    assert not problems, problems


def test_entry_gives_ranked_hotspots(spark, folder):
    top = entry.entry(spark)
    assert top.count() == 20
    assert "risk_score" in top.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
