"""Every engine query that SQL can express gives what the SQL gives; the others run."""

from __future__ import annotations

import pytest

from barloom.plans import catalog

from .oracle import difference


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, small, name):
    assert difference(catalog.queries()[name](spark, small), catalog.oracle_sql()[name], small) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["symbol", "position", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
