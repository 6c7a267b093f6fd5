"""Every check that SQL can express, in Spark and in DuckDB on the same files."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import verify  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from driftgate.plans.catalog import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return verify.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_check(spark, sf, con, name):
    same, note = verify.compare(spark, con, name, sf)
    assert same, note


def test_every_oracle_has_its_check():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 2
