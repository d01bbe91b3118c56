"""Every registered query against its SQL; those without SQL give rows."""

import pytest
from compare import agree

from quillspark.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    agree(QUERIES[name](spark, small), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
