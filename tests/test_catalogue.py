import pytest

from faultline import catalogue, catalogue_cases  # noqa: F401
from tests.oracle import connect, same

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    assert same(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], DATA) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
