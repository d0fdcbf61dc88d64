"""Every registered query of the core against its SQL on the small tables; queries without SQL must run."""

import math
import os

import pytest

from loamgrid.plans import model_queries, problem_queries, shape_queries, spatial_queries, table_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
MODULES = (problem_queries, table_queries, spatial_queries, shape_queries, model_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(tuple(_cell(r[c]) for c in cols) for r in got.collect())
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(_cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
