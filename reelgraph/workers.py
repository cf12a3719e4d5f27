"""Python workers and this package, and tables that a search keeps between its steps."""

from __future__ import annotations

import os
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Rows for which dealt() makes a further bucket.
ROWS = 64


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout; on a cluster it comes by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def bounded(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the batches that go to Python workers by bytes, unless the user did: rows may hold pictures."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") == "64m":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class _Made(threading.local):
    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may do without that setting: it gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/reelgraph"
    if base.startswith("/") and spark.sparkContext.master.startswith("local"):
        base = f"file://{base}"
    _made.paths.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written to a shared folder and read again: made once however often it is used, and its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession, rows: int) -> int:
    """Of how many buckets a table of so many rows is dealt: as many as shuffles have partitions, and fewer for few rows."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)))


def tables(spark: SparkSession) -> bool:
    """Whether the session can hold tables. A table in a folder of its own needs the default database all the same, and with it a
    warehouse that the driver can make."""
    path = shared_folder(spark, "probe")
    try:
        spark.range(0).write.format("parquet").bucketBy(1, "id").option("path", path).saveAsTable(_table(path))
        spark.sql(f"DROP TABLE {_table(path)}")
    except Exception:  # whatever it is, rows can be shuffled
        return False
    return True


def dealt(df: DataFrame, by: str, n: int, table: bool = True) -> DataFrame:
    """kept(), in n buckets of the column by, as a table of the session until its folder is dropped. What beside() joins to it
    comes to its rows; they stay where they are. table: see tables(); without, it is kept() only, and beside() shuffles its rows."""
    if not table:
        return kept(df)
    path = shared_folder(df.sparkSession, "dealt")
    df.write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(_table(path))
    return df.sparkSession.table(_table(path))


def beside(rows: DataFrame, more: DataFrame, by: str, n: int, how: str = "inner") -> DataFrame:
    """rows of a table of dealt() with the columns of more, which has at most a row for each value of by. Only more is shuffled."""
    return rows.join(more.repartition(n, by).hint("shuffle_hash"), by, how)


def _table(path: str) -> str:
    return "spark_catalog.default.reelgraph_" + path.rsplit("/", 1)[1].replace("-", "_")


def drop(spark: SparkSession, path: str) -> None:
    if path.rsplit("/", 1)[1].startswith("dealt-"):
        spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Folders that are made inside the block go at its end, but for those that are handed out by keep().

    with Scratch(spark) as s: ...; return s.keep(result)
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.saved = spark, []

    def __enter__(self) -> Scratch:
        self.outer, _made.paths = _made.paths, []
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        out = kept(df, "result")
        self.saved.append(_made.paths.pop())
        return out

    def __exit__(self, *error) -> None:
        for path in _made.paths:
            drop(self.spark, path)
        _made.paths = self.outer + self.saved


def drop_kept(spark: SparkSession) -> None:
    """Delete all folders made in this thread; what was read from them can't be read afterwards."""
    while _made.paths:
        drop(spark, _made.paths.pop())
