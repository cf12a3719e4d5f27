"""Views of the tables: frames of videos, spoken segments, timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.functions.vectors import doubles


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, label, v): a hundred frames to a video."""
    e = read(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") / 100).cast("long").alias("video_id"), (F.col("vec_id") % 100).cast("int").alias("frame_idx"), "label", doubles(F.col("embedding")).alias("v"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, option, kv): a video's question has an option for each label among its frames; its vector is that
    of the label's frame of least id."""
    f = frames(spark, sf_dir).select("video_id", "label").distinct()
    kv = read(spark, sf_dir, "embeddings").groupBy("label").agg(doubles(F.min_by("embedding", "vec_id")).alias("kv"))
    return f.join(kv, "label").select("video_id", F.col("label").alias("option"), "kv")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, start, end, text): turns of a conversation, one every 15 s, 20 s long."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), (F.col("turn") * 15).alias("start"), (F.col("turn") * 15 + 20).alias("end"), "text")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, event_id, start, end, description): events of 5 s, at the second that their id leaves modulo 100."""
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("video_id"), "event_id", (F.col("event_id") % 100).cast("double").alias("start"), (F.col("event_id") % 100 + 5).cast("double").alias("end"), F.col("event_type").alias("description"))
