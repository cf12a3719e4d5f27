"""Queries on odd tables give DuckDB's rows, too."""

import duckdb
import pytest
from pyspark.sql import functions as F

from reelgraph import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations events".split()


def held(spark, folder, name, **tables):
    """The query gives the rows of its SQL over these tables, and those of DIR for the others."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        tables.get(t, spark.read.parquet(f"{DIR}/{t}.parquet")).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    df = plans.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({plans.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


def test_diversity_fill_of_a_short_last_video(spark, tmp_path):
    held(spark, tmp_path, "diversity_fill", embeddings=spark.read.parquet(f"{DIR}/embeddings.parquet").where("vec_id < 356"))
