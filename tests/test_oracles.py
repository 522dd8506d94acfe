"""Every registered query of the evaluation against its SQL twin, on the smallest tables."""

import pytest

from liftline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, small, duck, same, name):
    same(registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, medium, name):
    assert registry.QUERIES[name](spark, medium).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
