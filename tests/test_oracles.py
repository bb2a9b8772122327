"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from quarrymill.plans import catalog

from .compare import same
from .conftest import SMALL

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        same(got, duck.execute(SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
