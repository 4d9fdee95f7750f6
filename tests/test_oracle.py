"""Every registered query against its DuckDB twin."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert name in ORACLES
    assert difference(df, duck, ORACLES[name]) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
