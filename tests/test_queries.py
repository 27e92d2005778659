"""Every core query over the smallest tables, against its SQL where there is one."""

import os

import pytest
from conftest import SMALL

from lakeloom.plans import problems
from lakeloom.plans import queries as core

ALL = {**problems.QUERIES, **core.QUERIES}
SQL = {**problems.ORACLES, **core.ORACLES}


def value(x):
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


def compare(spark, name, query, sql):
    duckdb = pytest.importorskip("duckdb")
    df = query(spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(value, r)) for r in df.select(*cols).collect())
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    picked = ", ".join(f'"{c}"' for c in cols)
    assert rows == sorted(tuple(map(value, r)) for r in con.sql(f"select {picked} from ({sql})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    compare(spark, name, ALL[name], SQL.get(name))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
