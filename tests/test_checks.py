"""Every registered query against its check SQL (rows only where there is none), on the smallest tables."""

import pytest

from dockflow.catalog import load
from tests.compare import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = load()


def test_names():
    assert set(CHECKS) <= set(QUERIES)
    assert len(QUERIES) > 140


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in CHECKS:
        ok, why, _ = compare(spark, FOLDER, QUERIES[name], CHECKS[name])
        assert ok, why
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0
    spark.catalog.clearCache()
