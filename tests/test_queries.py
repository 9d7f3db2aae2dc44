import os

import pytest
from parity import assert_same, by_sql

from fleetward import queries as fleet

SF = "/root/testdata/sf0.001"
#: Their SQL takes the combinations of five eligible devices, which the smallest tables don't have.
LARGER = {"o04_macro_objective", "o04_macro_allocation", "o05_minimax_objective", "o07_test_oracle", "j13_exhaustive_macro"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(fleet.ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else SF
    assert_same(fleet.QUERIES[name](spark, sf).toPandas(), by_sql(sf, fleet.ORACLES[name]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(fleet.QUERIES) - set(fleet.ORACLES)))
def test_query_runs(spark, name):
    assert fleet.QUERIES[name](spark, SF).count() >= 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
