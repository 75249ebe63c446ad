"""The entry points, and every query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corelattice import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _plain(v.item())
    return str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = core.QUERIES[name](spark, SF)
    want = con.execute(core.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(_plain(v) for v in r) for r in want.fetchall())
    assert len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
