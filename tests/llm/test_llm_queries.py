"""Every query of the subpackage runs on the smallest tables; those with an SQL twin give its rows."""

import os

import pytest

from compare import digest, duck
from quillon.llm import queries
from quillon.llm.bpe import DEFAULT_VOCABULARY


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    if name.startswith(("p6_", "p7_")) and not os.path.exists(DEFAULT_VOCABULARY):
        pytest.skip("no public vocabulary here")
    df = queries.QUERIES[name](spark, sf)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    if name in queries.ORACLE:
        cur = duck(sf).execute(queries.ORACLE[name])
        expected = digest([d[0] for d in cur.description], cur.fetchall())
        assert got[:2] == expected[:2] and got[3] == expected[3]
