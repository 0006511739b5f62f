"""Every query of the subpackage runs on the smallest tables; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

from sonarloom.llm import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        assert sorted(map(tuple, got[sorted(got)].astype(str).values.tolist())) == sorted(map(tuple, want[sorted(want)].astype(str).values.tolist()))
