import glob
import os

import duckdb
import pytest

from linkloom.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(columns).collect())
    if name not in SQL:
        assert rows
        return
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
