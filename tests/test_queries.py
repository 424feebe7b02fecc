"""Every civic query against its DuckDB twin, and rows-only checks of the few without one."""

import pytest
from conftest import same

from wardlight.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in ORACLE_SQL:
        assert same(rows, df.columns, duck.sql(ORACLE_SQL[name]))
    else:
        assert rows


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
