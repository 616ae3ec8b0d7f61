"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.conftest import DATA, rows
from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    expected = duck.execute(SQL[name])
    frame = expected.fetch_df()
    assert sorted(df.columns) == sorted(frame.columns)
    kinds = {r[0]: r[1] for r in duck.execute(f"describe {SQL[name]}").fetchall()}
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    assert rows(df.toPandas()) == rows(frame)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
