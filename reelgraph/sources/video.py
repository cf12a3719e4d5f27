"""Sources and sinks around videos: plans of which frames to read, point and range reads, image files, decoders,
question files, transcripts, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of video files, in the order in which they are looked for.
ENDINGS = ("mp4", "avi", "mkv", "webm", "mov")


def sample_plan(videos: DataFrame, fps: float = 1.0, most: int | None = None) -> DataFrame:
    """(video_id, frame, ts): which frames of a video (video_id, total, native_fps) a sampling reads, without reading any.

    One every native_fps / fps frames from 0 on; evenly spread ones over all instead if they would be more than most.
    """
    step = F.col("native_fps") / F.lit(fps)
    n = F.ceil(F.col("total") / step).cast("int")
    every = F.when((F.col("total") > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * step).cast("int"))).otherwise(F.array().cast("array<int>"))
    if most is not None:
        last = (F.col("total") - 1).cast("double")
        few = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (i * last / F.lit(max(1, most - 1))).cast("int"))
        every = F.when(F.size(every) > most, few).otherwise(every)
    kept = F.array_distinct(F.transform(every, lambda i: F.least(i, (F.col("total") - 1).cast("int"))))
    return videos.select("video_id", "native_fps", F.explode(kept).alias("frame")).select("video_id", "frame", (F.col("frame") / F.col("native_fps")).alias("ts"))


def clip_plan(videos: DataFrame, centre: Column, window: float = 2.0, fps: float = 1.0) -> DataFrame:
    """(video_id, frame, ts): frames within window seconds of a point in time, inside the video; the last one is left out."""
    native = F.col("native_fps")
    a = (F.greatest(F.lit(0.0), centre - window) * native).cast("int")
    z = (F.least(F.col("total") / native, centre + window) * native).cast("int")
    step = native / F.lit(fps)
    n = F.ceil((z - a) / step).cast("int")
    every = F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least((a + i * step).cast("int"), (F.col("total") - 1).cast("int")))))
    return videos.select("video_id", "native_fps", F.explode(every).alias("frame")).select("video_id", "frame", (F.col("frame") / F.col("native_fps")).alias("ts"))


def frames_at(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of frames that wanted (video_id, frame_idx) names; what isn't there is left out."""
    return frames.join(wanted.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")


def video_info(frames: DataFrame, fps: float = 1.0) -> DataFrame:
    """(video_id, total_frames, fps, duration) of frames (video_id, frame_idx, ...) at a rate."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("total_frames"))
    return n.select("video_id", "total_frames", F.lit(fps).alias("fps"), (F.col("total_frames") / F.lit(fps)).alias("duration"))


class LazyFrames:
    """One video's frames (frame_idx, ...), read when they are asked for. Positions count from 0 in order of frame_idx."""

    def __init__(self, frames: DataFrame, video_id: int):
        own = frames.where(F.col("video_id") == video_id)
        self.rows = own.withColumn("position", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1)

    def __len__(self) -> int:
        return self.rows.count()

    def get_batch(self, positions: Sequence[int]) -> DataFrame:
        """Rows at positions; those beyond the end are left out."""
        return self.rows.where(F.col("position").isin([int(p) for p in positions])).orderBy("position")

    def __getitem__(self, at: int | slice) -> DataFrame:
        n = len(self)
        if isinstance(at, slice):
            return self.get_batch(range(*at.indices(n)))
        if not -n <= at < n:
            raise IndexError(at)
        return self.get_batch([at % n])


class LazyImages:
    """Image files by position; those that can't be read are left out of a batch."""

    def __init__(self, spark: SparkSession, paths: Sequence[str]):
        self.spark, self.paths = spark, list(paths)

    def __len__(self) -> int:
        return len(self.paths)

    def get_batch(self, positions: Sequence[int]) -> DataFrame:
        """(path, content) of those that are there."""
        own = [self.paths[p] for p in positions if 0 <= p < len(self.paths)]
        read = self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
        try:
            return read.load(own).select("path", "content") if own else self.spark.createDataFrame([], "path string, content binary")
        except Exception as error:  # a path that is missing before anything is read
            if "PATH_NOT_FOUND" not in str(error):
                raise
            there = [p for p in own if self._exists(p)]
            return read.load(there).select("path", "content") if there else self.spark.createDataFrame([], "path string, content binary")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def __getitem__(self, at: int | slice) -> DataFrame:
        if isinstance(at, slice):
            return self.get_batch(range(*at.indices(len(self))))
        got = self.get_batch([range(len(self))[at]])
        if got.isEmpty():
            raise IndexError(f"{self.paths[at]} can't be read")
        return got


def decoded(files: DataFrame, decode: Callable[[bytes], Iterator[tuple[int, float, bytes]]], plan: DataFrame | None = None) -> DataFrame:
    """(path, frame, ts, image) of video files (path, content), by a decoder that yields (frame, seconds, image).

    The decoder runs in Python workers, a file at a time. plan: (path, frame), the frames that are wanted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(path, *x) for x in decode(content)], columns=["path", "frame", "ts", "image"])

    out = files.select("path", "content").mapInPandas(run, "path string, frame int, ts double, image binary")
    return out if plan is None else out.join(plan.select("path", "frame"), ["path", "frame"], "left_semi")


def questions_file(spark: SparkSession, path: str) -> DataFrame:
    """(row, video, question, candidates, truth, query) of a tab separated file with a header.

    The video's name is in the column video, else video_id, else sample_ROW; the options are in candidates, else
    options. Missing columns are empty. row counts from 0; such files are small, so they are numbered in one task.
    """
    t = spark.read.option("sep", "\t").option("header", "true").option("multiLine", "true").csv(path)
    t = t.withColumn("row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    first = lambda names, last: next((F.col(n) for n in names if n in t.columns), last)
    none = F.lit("")
    out = t.select("row", first(("video", "video_id"), F.concat(F.lit("sample_"), "row")).alias("video"), first(("question",), none).alias("question"), first(("candidates", "options"), none).alias("candidates"), first(("answer",), none).alias("truth"))
    text = lambda c: F.coalesce(c, none)
    return out.select("row", "video", text("question").alias("question"), text("candidates").alias("candidates"), text("truth").alias("truth"), F.concat(text("question"), F.lit(" Options: "), text("candidates")).alias("query"))


def video_files(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(video, path) for names wanted (video): a file of that name in the folder, in the order of ENDINGS, else one
    below it. Only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.array_position(F.array(*map(F.lit, ENDINGS)), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    depth = F.size(F.split("path", "/"))
    files = files.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("video"), ending.alias("ending"), depth.alias("depth")).where("ending > 0")
    least = files.agg(F.min("depth")).first()[0]
    best = files.groupBy("video").agg(F.min_by("path", F.struct(F.col("depth") > (least or 0), "ending", "path")).alias("path"))
    return wanted.select("video").join(best, "video", "left")


TRANSCRIPT = "video_id long, start double, end double, text string"


def transcripts(spark: SparkSession, path: str | None, wanted: bool = True, transcribe: Callable[[str], Iterator[tuple[float, float, str]]] | None = None, videos: DataFrame | None = None) -> DataFrame:
    """Spoken segments (TRANSCRIPT), trimmed: from a table at path, or by a transcriber of videos (video_id, path).

    None of these, or not wanted: an empty table. A video whose transcriber fails has no segments.
    """
    if not wanted or (path is None and (transcribe is None or videos is None)):
        return spark.createDataFrame([], TRANSCRIPT)
    if path is not None:
        return spark.read.schema(TRANSCRIPT).parquet(path).withColumn("text", F.trim("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for video, file in zip(pdf["video_id"], pdf["path"], strict=True):
                try:
                    rows = [(video, a, z, t.strip()) for a, z, t in transcribe(file)]
                except Exception:  # noqa: S112
                    continue
                yield pd.DataFrame(rows, columns=["video_id", "start", "end", "text"])

    return videos.select("video_id", "path").mapInPandas(run, TRANSCRIPT)


def write_answers(answers: DataFrame, path: str) -> None:
    """Results as JSON lines, and beside them a table of every step and every line of evidence, for looking them up."""
    answers.write.mode("overwrite").json(f"{path}/answers")
    answers.selectExpr("question_id", "posexplode(steps) AS (step, s)").selectExpr("question_id", "step", "s.*").write.mode("overwrite").parquet(f"{path}/steps")
    answers.selectExpr("question_id", "inline(lines)").write.mode("overwrite").parquet(f"{path}/evidence")
