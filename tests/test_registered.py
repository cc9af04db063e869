"""Every registered query against its SQL on the smallest tables; those without SQL must run and return rows."""

import pytest
from conftest import canonical

from motionlake import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small_dir, name):
    got = QUERIES[name](spark, small_dir).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
