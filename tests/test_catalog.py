"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from seekframe.plans import catalog
from tests.conftest import same_rows

WITH_SQL = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_its_sql(name, spark, sf_dir, oracle):
    same_rows(catalog.queries()[name](spark, sf_dir), oracle.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(WITH_SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = catalog.queries()[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
