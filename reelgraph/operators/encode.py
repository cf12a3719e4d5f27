"""Vectors of pictures and texts, by models that live in Python workers.

Rows stream through Arrow: a worker makes its model once for each task and hands it batches of a fixed size, filled across the
batches that Spark sends, so a task holds one batch of pictures whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from reelgraph.models import Models
from reelgraph.sources.frames import read_frames
from reelgraph.workers import bounded, reachable

#: Rows of a call, and the least length by which a vector is divided.
BATCH, FLOOR = 32, 1e-8


def unit(x: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), floor)


def refilled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The same rows in tables of size rows; the last may have fewer."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= size:
            yield pa.Table.from_batches([*held, b.slice(0, size - n)])
            b, held, n = b.slice(size - n), [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _encoded(rows: DataFrame, column: str, call: Callable[[Models, list], np.ndarray], models: Callable[[], Models], batch: int, out: str) -> DataFrame:
    reachable(rows.sparkSession)
    bounded(rows.sparkSession)
    schema = StructType([*(f for f in rows.schema if f.name != out), StructField(out, ArrayType(DoubleType(), False))])
    keep = [f.name for f in schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for t in refilled(batches, batch):
            given = t.column(column).to_pylist()
            there = [k for k, x in enumerate(given) if x is not None]
            vectors: list = [None] * len(given)
            if there:
                model = models() if model is None else model
                for k, v in zip(there, unit(call(model, [given[k] for k in there])), strict=True):
                    vectors[k] = v
            t = t.select(keep).append_column(out, pa.array(vectors, pa.list_(pa.float64())))
            yield from t.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def encode_frames(frames: DataFrame, models: Callable[[], Models], batch: int = BATCH, out: str = "v") -> DataFrame:
    """frames (..., image binary) with the column out: the picture's vector, of unit length; a vector below 1e-8 is divided by that.

    The model gets batch pictures in a call. A null picture has a null vector and isn't sent. All columns are
    handed on; one that is called like out is replaced. An empty table stays empty.
    """
    return _encoded(frames, "image", lambda m, x: m.encode_images(x), models, batch, out)


def encode_texts(texts: DataFrame, models: Callable[[], Models], column: str = "text", batch: int = BATCH, out: str = "u") -> DataFrame:
    """texts with the column out: the text's vector in the space of the pictures, of unit length. Null texts have none."""
    return _encoded(texts, column, lambda m, x: m.encode(x), models, batch, out)


def encode_videos(spark: SparkSession, path: str, models: Callable[[], Models], fps: float = 1.0, most: int | None = None, batch: int = BATCH) -> DataFrame:
    """(path, position, frame, ts, v): vectors of a folder's videos, sampled at fps, by the source "frames".

    Only the bytes of sampled frames are read. position counts a video's sampled frames from 0 on. Files that can't be read have no rows.
    """
    return encode_frames(read_frames(spark, path, fps, most), models, batch).select("path", "position", "frame", "ts", "v")
