"""Every core query runs on the smallest tables; those with an SQL twin give its rows."""

import pytest

from compare import digest, duck
from quillon.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLE:
        cur = con.execute(catalog.ORACLE[name])
        expected = digest([d[0] for d in cur.description], cur.fetchall())
        assert got[:2] == expected[:2] and got[3] == expected[3]


def test_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
