"""Every registered query against its SQL on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_queries import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not here")


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, name):
    verdict = compare(spark, FOLDER, name, contract.oracle_sql().get(name))
    assert verdict.startswith(("equal", "rows only")), verdict


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[-1] == "label" and rows.count() > 0


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
