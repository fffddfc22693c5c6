"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import oracle
import pytest

from weftline.plans import catalog


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connection(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, con, name):
    df = catalog.QUERIES[name](spark, folder)
    if name in catalog.ORACLES:
        assert oracle.difference(df, con, catalog.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
