"""Every query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from folioframe.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float | np.floating):
        return round(float(v), 6)
    return bool(v) if isinstance(v, np.bool_) else int(v) if isinstance(v, np.integer) else v


def rows(pdf):
    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 50
