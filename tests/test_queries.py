"""Every query against the SQL it equals, and the driver's contract."""

import pytest

from conftest import SMALL, rows_of
from textloom import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    made = core.QUERIES[name](spark, SMALL).toPandas()
    assert len(made)
    if name in core.ORACLE_SQL:
        wanted = duck.sql(core.ORACLE_SQL[name]).df()
        assert sorted(wanted.columns) == sorted(made.columns)
        assert rows_of(wanted, sorted(wanted.columns)) == rows_of(made, sorted(made.columns))


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
