"""Every registered query against its SQL; those without SQL by their properties."""

import re

import pytest

from keyloom.operators import ordering
from keyloom.plans import catalog

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    ordering.release(spark)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first().matches > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_strategies_have_plans_of_their_own(spark):
    """Each join strategy reads, deals or looks up in a way that no other one does."""
    from keyloom.operators import joins

    build, probe = catalog.r(spark, SF), catalog.s_missing(spark, SF)

    def shape(name):
        plan = joins.join(build, probe, name)._jdf.queryExecution().optimizedPlan().toString()
        return re.sub(r"#\d+L?|\d+", "", plan)

    shapes = {name: shape(name) for name in joins.STRATEGIES}
    assert len(set(shapes.values())) == len(shapes)


def test_range_workload_grows_with_orders(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert catalog.QUERIES["probe_ranges"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
