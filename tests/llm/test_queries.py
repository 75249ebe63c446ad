"""The pN_ queries on the smallest tables, against their SQL where there is one."""

import os

import duckdb
import pytest

from corelattice.llm import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_and_agrees(spark, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in oracle.ORACLE:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(oracle.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(tuple(r)) for r in want.fetchall())
