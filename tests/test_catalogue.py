"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from weirflow import catalogue


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query(name, same):
    same(catalogue.QUERIES[name], catalogue.SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["l_orderkey", "qty_hundredths", "max_price", "n"]
