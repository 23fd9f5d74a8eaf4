"""Every query that has SQL gives the SQL's rows."""

import pytest
from conftest import SF, same_rows

from tracewell.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        same_rows(df, duck.sql(registry.SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
