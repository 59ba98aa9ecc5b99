"""Every registered query against its SQL in another engine, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from stratagraph.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or (not isinstance(v, (str, dict)) and pd.isna(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer, float, np.floating)):
        return round(float(v), 9)
    return str(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows(spark, other, name):
    ours, theirs = QUERIES[name].run(spark, FOLDER).toPandas(), other.execute(QUERIES[name].sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, FOLDER).count() > 0


def test_names_are_unique():
    assert all(name == q.name and q.operators for name, q in QUERIES.items())
