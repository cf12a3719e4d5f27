"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from reelgraph import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations events".split()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = plans.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({plans.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
