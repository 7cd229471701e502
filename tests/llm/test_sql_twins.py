"""Queries that SQL can express give what their SQL gives."""

import glob
import os

import duckdb
import pytest

from linkloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    rows = sorted(repr(tuple(r)) for r in got.select(columns).collect())
    assert rows and rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
