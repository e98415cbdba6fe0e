"""Every registered query against its SQL text on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from plumbline.registry import CATALOG

SF_DIR = "/root/testdata/sf0.001"
entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    status, _, _, _ = compare(spark, con, name, CATALOG[name], SF_DIR)
    assert status in ("ok", "rows", "EMPTY"), status


def test_most_queries_have_sql():
    assert len(entry.oracle_sql()) >= 0.9 * len(entry.queries())
