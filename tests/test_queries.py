"""Every registered query against SQL on the same tables, or, without SQL, that it gives rows."""

import pytest

from catchment import registry

from .compare import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, data, name):
    same(QUERIES[name](spark, data), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_no_nested_loop_in_spatial_joins(spark, data):
    from catchment.operators import spatial

    t = registry.Tables(spark, data)
    plan = spatial.radius_join(t.sites, t.elements, 2000.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
