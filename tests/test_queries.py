import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[:2] == ["ts", "plant"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    result = compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name])
    spark.catalog.clearCache()
    assert result.startswith("ok"), result
