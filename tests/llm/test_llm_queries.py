"""The queries of the package against their SQL on the small tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def _names():
    from loamgrid.llm.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from loamgrid.llm.queries import ORACLE, QUERIES

    got = QUERIES[name](spark, DATA)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows == sorted(repr(tuple(r[cols.index(c)] for c in sorted(cols))) for r in cur.fetchall())
