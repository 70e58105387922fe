"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from conftest import SMALL, rows

from graphemica.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    assert len(found)
    if name in ORACLE_SQL:
        assert rows(found) == rows(duck.execute(ORACLE_SQL[name]).df())
    if "lossless" in found:
        assert found["lossless"].all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
