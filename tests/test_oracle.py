"""Every query with an SQL form against DuckDB."""

import pytest
from oracle import canonical, expected

from quillspark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = expected(catalog.ORACLE_SQL[name], sf_dir)
    assert names == want_names
    assert rows == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
