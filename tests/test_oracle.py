"""Every query that has SQL, against that SQL."""

import math
import os

import duckdb
import pytest

from sonaria.plans import catalog

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cell(x):
    return ("nan" if math.isnan(x) else repr(x + 0.0)) if isinstance(x, float) else repr(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = table(df.collect(), df.columns)
    cur = con.execute(catalog.SQL[name])
    want = table(cur.fetchall(), [c[0] for c in cur.description])
    assert got == want and got[1]


def test_rows_only(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, DIR).count() > 0
