"""Every registered query against its SQL twin, on the smallest data."""

import pytest

import check_oracles
from vacantia.oracle.queries_sql import ORACLES
from vacantia.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ENTRY = check_oracles.entry


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert check_oracles.compare(spark, con, FOLDER, name) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert ENTRY.entry(spark).columns[0] == "doc_id"
