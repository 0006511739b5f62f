"""Every core query runs on the smallest tables, and agrees with its SQL."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sonarloom.plans import catalog


def cells(frame):
    def shown(v):
        if isinstance(v, (list, np.ndarray)):
            return repr(list(v))
        if isinstance(v, float) and v.is_integer():
            v = int(v)  # pandas makes floats of integers beside nulls
        return "" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else str(v)

    return sorted(tuple(shown(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
