"""What queries() adds for the training-data operators, and the SQL that says the same."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratagraph.llm import registry


def test_every_operator_has_one_query():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(names) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_rows_as_sql(spark, folder, name):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    theirs = c.execute(registry.oracle_sql()[name])
    cols = sorted(d[0] for d in theirs.description)
    want = sorted((tuple(r[[d[0] for d in theirs.description].index(k)] for k in cols) for r in theirs.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in cols) for r in registry.queries()[name](spark, folder).collect()), key=repr) == want
