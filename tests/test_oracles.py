"""Every registered query against its SQL on the smallest tables."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from tandem.plans.registry import QUERIES
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out = compare(spark, con, name, SF)
    assert not out.startswith("FAIL"), out


def test_entry(spark):
    assert E.entry(spark).count() == 8
    assert set(E.oracle_sql()) <= set(E.queries())
