"""Every query with SQL gives DuckDB's rows; the others give rows."""

from __future__ import annotations

import pytest

from skyplume.jobs import catalog
from tests.conftest import SF, plain


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name]).df()
        a, b = plain(got), plain(want)
        assert list(a.columns) == list(b.columns)
        assert a.to_numpy().tolist() == b.to_numpy().tolist()
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
