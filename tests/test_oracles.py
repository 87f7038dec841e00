"""Every registered query against its oracle on the smallest folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.registry import BASE, QUERIES
from tests.oracle_check import norm

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)  # those of the corpus operators have tests of their own
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    rows = entry.queries()[name](spark, FOLDER)
    cols = sorted(rows.columns)
    mine = sorted("|".join(norm(r[c]) for c in cols) for r in rows.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    index = [names.index(c) for c in cols]
    assert mine == sorted("|".join(norm(r[i]) for i in index) for r in cursor.fetchall())
