"""Every registered query against its SQL, on the smallest tables."""

import pytest

import catalog
import check

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert check.compare(spark, con, SF_DIR, name).startswith("ok")


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
