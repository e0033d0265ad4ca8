"""Every query of the catalog that has an oracle gives DuckDB's rows on the smallest data."""

import os

import pytest
from helpers import DATA, duck, same

from treeflow.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    same(catalog.QUERIES[name](spark, f"{DATA}/sf0.001"), con, catalog.ORACLES[name])


#: Their rows don't come from tables of the data set.
ROWS_ONLY = {"s03_simulator_counts", "s04_local_fs_listing"}


def test_every_other_query_has_an_oracle():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows(spark, name):
    assert not catalog.QUERIES[name](spark, f"{DATA}/sf0.001").isEmpty()
