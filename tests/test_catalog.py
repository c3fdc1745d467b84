"""Every registered reference query against its oracle SQL, or for rows alone."""

from __future__ import annotations

import pytest

from sitewright import catalog
from tests.oracle import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    query = catalog.queries()[name]
    if name in SQL:
        assert_same(spark, query, SQL[name], sf_dir)
    else:
        assert query(spark, sf_dir).count() > 0


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["path", "change"]
