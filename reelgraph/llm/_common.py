"""What the operators share: folders all executors see, iterative labels, byte-level hashing."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 2 << 20


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout, and bound their batches by bytes.

    Texts may be long: a batch of Spark's usual 10,000 rows can take a worker hundreds of MB.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") == "64m":  # not set by the user
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


class _Made(threading.local):
    def __init__(self):
        self.paths: list[str] = []


#: Folders made by this thread, newest last. They stay until drop_made(), as results are read from them.
MADE = _Made()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session may do without that: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/reelgraph"
    if base.startswith("/") and spark.sparkContext.master.startswith("local"):
        base = f"file://{base}"
    MADE.paths.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return MADE.paths[-1]


def drop_made(spark: SparkSession) -> None:
    """Delete all folders that operators made in this thread; their results can't be read afterwards."""
    while MADE.paths:
        drop_dir(spark, MADE.paths.pop())


def release() -> None:
    """Give a worker's free memory back, so that it doesn't hold it while later stages run."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # no glibc
        pass


def released(run):
    """A batch function that calls release() when its partition is done."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_local(path: str):
    """(file system, path in it) of a shared folder, for Python code on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path.replace("file:/", "/", 1) if path.startswith("file:/") else path)


def components(edges: DataFrame, work: str) -> DataFrame:
    """Connected components of (u, v): one row (node, label) per node, label the smallest node reached.

    Every node takes the smallest label among its neighbours, then the label's own label (pointer
    jumping), until nothing changes. Joins and aggregates only, so a hub's edges stay spread out.
    Null ends are ignored; loops and repeated edges do no harm; no edges give no rows.
    """
    both = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v")
    both = stored(both.unionByName(both.selectExpr("v AS u", "u AS v")).distinct(), f"{work}/edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), f"{work}/labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = stored(step, f"{work}/step-{turn}")
        of = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = step.join(of, "label").select("node", "was", F.least("label", "next").alias("label"))
        jumped = stored(jumped, f"{work}/labels-{turn}")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels


#: Byte-level polynomial hashing modulo 2^64: a random odd base and a random value per byte.
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 2**62)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], filled = 1, 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * np.uint64(pow(base, filled, 2**64))
            filled *= 2
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """p with p[i] the hash of buf[:i]; span_hash() takes spans from it."""
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * powers(BASE, len(buf)), out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end, whatever stands before them."""
    return mix((p[end] - p[start]) * powers(BASE_INVERSE, len(p))[start])


def rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(*(pdf[n] for n in names), strict=True)
