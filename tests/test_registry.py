"""Every registered query beside its SQL."""

import pytest
from compare import compare, sql_engine

import __spark_entry__ as entry_points

QUERIES = {name: query for name, query in entry_points.queries().items() if name in entry_points.QUERIES}
ORACLES = {name: sql for name, sql in entry_points.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def engine(folder):
    return sql_engine(folder)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, engine, folder, name):
    result = compare(spark, engine, name, QUERIES[name], ORACLES.get(name), folder)
    assert result["ok"], result["why"]


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["query_id", "prompt"]
    assert result.count() > 0
