"""Operators whose results SQL can express, on the smallest tables."""

import pytest
from conftest import SMALL, rows

from graphemica.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
