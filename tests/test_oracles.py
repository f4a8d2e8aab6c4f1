"""Every query of the library proper against its SQL, over whole tables."""

import pytest
from oracle import assert_same

from flowframe.plans.oracles import ORACLES
from flowframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES, ORACLES, name, SF)


def test_every_query_but_the_forest_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"isolation_outliers"}


def test_entry_and_queries_load(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
