"""Every registered query against its SQL in DuckDB."""

import pytest

from checks import load, registry
from checks.compare import compare, connect

load()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF_DIR, name)
    assert ok, note


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
