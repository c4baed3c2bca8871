"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from askbase.registry.oracles import ORACLES
from askbase.registry.queries import QUERIES
from run_checks import compare

DATA = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    problem, _, _ = compare(spark, DATA, name)
    assert problem in (None, "both empty"), problem


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "mentioned_clients" in frame.columns
