"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    result = compare(spark, contract.queries()[name], contract.oracle_sql().get(name), FOLDER, con)
    assert result["ok"] is not False, result["problems"]


def test_entry(spark):
    assert contract.entry(spark).count() >= 0


def test_earlier_names_of_the_searches_stay():
    assert {"keyword_match_grams", "search_all_by_term", "search_bool_by_term"} <= set(contract.oracle_sql())


def test_sql_names_are_registered():
    assert set(contract.oracle_sql()) <= set(contract.queries())
