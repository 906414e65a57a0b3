"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sluice.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    out = catalog.queries()[name](spark, DATA)
    if name not in catalog.oracle_sql():
        assert len(out.collect()) >= 0
        return
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(out.columns)
    assert plain([tuple(r) for r in out.collect()], out.columns) == plain(cursor.fetchall(), columns)
