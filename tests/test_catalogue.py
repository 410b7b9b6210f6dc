"""Every registered query with SQL gives what DuckDB makes of that SQL."""

import os

import duckdb
import pytest

from onomast.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLES[key]})").fetchall()
    assert got == sorted(str(r) for r in want)
