"""Every registered query against its SQL on the smallest given tables."""

import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tapeworks.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_every_query_has_sql():
    """Queries of the corpus operators without SQL are tested beside their operators."""
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    msg, _, _ = check.compare(spark, con, name, SF)
    assert msg.startswith("ok"), msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "sharpe_ratio" in df.columns
