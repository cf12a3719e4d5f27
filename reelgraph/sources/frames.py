"""Frames of video containers as a table: the data source "frames", and what a container's head says.

Containers are those of boxes (mp4, mov, m4v). A head is the box moov: its sample tables say where the bytes of each frame lie and when
it is shown, so a frame is read by its range of bytes. Partitions are planned from sizes of files alone, as ranges of
bytes of about SPLIT; a task reads its files' heads and of their frames those that begin in its range, pass the filters that were
pushed down (on path and frame) and belong to the sampling. What is read is the frame as it is stored: a picture where each
frame is one (motion JPEG and the like), else what a decoder needs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from reelgraph.workers import reachable

#: Bytes of a partition; bytes of a batch of frames; the largest head that is read.
SPLIT, BATCH, MOST_HEAD = 128 << 20, 8 << 20, 1 << 28
ENDINGS = (".mp4", ".mov", ".m4v")
#: Boxes that hold boxes on the way to the sample tables.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")

HEADS = "path string, length long, frames long, fps double, duration double, width int, height int"
FRAMES = "path string, frame int, position int, ts double, key boolean, image binary"


def opened(path: str):
    """(file system, path in it), for Python code."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass
class Head:
    """Of a container's first video track: size of the picture, and by frame its place, size, seconds and whether it stands alone."""

    width: int
    height: int
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    keys: np.ndarray
    duration: float
    fps: float | None


def boxes(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of the boxes in raw; one that is cut off raises ValueError."""
    at = 0
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        skip = 8
        if size == 1 and at + 16 <= len(raw):
            (size,), skip = struct.unpack_from(">Q", raw, at + 8), 16
        size = size or len(raw) - at
        if size < skip or at + size > len(raw):
            raise ValueError("a box is cut off")
        yield kind, raw[at + skip : at + size]
        at += size


def moov_of(file, length: int) -> bytes:
    """The body of the box moov; only heads of other boxes are read. ValueError if there is none."""
    at = 0
    while at + 8 <= length:
        file.seek(at)
        head = file.read(16)
        size, kind = struct.unpack_from(">I4s", head)
        skip = 8
        if size == 1 and len(head) == 16:
            (size,), skip = struct.unpack_from(">Q", head, 8), 16
        size = size or length - at
        if size < skip or at + size > length:
            break
        if kind == b"moov":
            if size > MOST_HEAD:
                raise ValueError("the head is too large")
            file.seek(at + skip)
            return file.read(size - skip)
        at += size
    raise ValueError("no head")


def _gathered(raw: bytes, out: dict) -> dict:
    """The bodies of all boxes below one, by kind."""
    for kind, body in boxes(raw):
        if kind in NESTED:
            _gathered(body, out)
        else:
            out.setdefault(kind, body)
    return out


def _table(body: bytes, kind: str, skip: int = 8) -> np.ndarray:
    """Numbers after a table's count, which stands at skip - 4."""
    (n,) = struct.unpack_from(">I", body, skip - 4)
    width = np.dtype(kind).itemsize
    if len(body) < skip + n * width:
        raise ValueError("a table is cut off")
    return np.frombuffer(body, kind, n, skip)


def track_of(raw: bytes) -> Head | None:
    """The head of a track (the body of its box trak); null if it isn't one of pictures."""
    b = _gathered(raw, {})
    if b.get(b"hdlr", b"")[8:12] != b"vide":
        return None
    long = b[b"mdhd"][0] == 1
    (scale,) = struct.unpack_from(">I", b[b"mdhd"], 20 if long else 12)
    width, height = (x >> 16 for x in struct.unpack_from(">II", b[b"tkhd"], 88 if b[b"tkhd"][0] == 1 else 76))
    runs = _table(b[b"stts"], ">u4,>u4")
    steps = np.repeat(runs["f1"].astype(np.int64), runs["f0"])
    (same, n) = struct.unpack_from(">II", b[b"stsz"], 4)
    sizes = np.full(n, same, np.int64) if same else _table(b[b"stsz"], ">u4", 12).astype(np.int64)
    chunks = (_table(b[b"stco"], ">u4") if b"stco" in b else _table(b[b"co64"], ">u8")).astype(np.int64)
    spread = _table(b[b"stsc"], ">u4,>u4,>u4")
    first = spread["f0"].astype(np.int64) - 1
    each = np.repeat(spread["f1"].astype(np.int64), np.diff([*first, len(chunks)])) if len(first) else np.zeros(0, np.int64)
    if len(steps) != n or each.sum() != n or scale == 0:
        raise ValueError("the tables disagree")
    # A frame begins after those before it in its chunk.
    ends = np.cumsum(sizes)
    chunk = np.repeat(np.arange(len(chunks)), each)
    start = np.concatenate(([0], np.cumsum(each)))[:-1]
    before = np.concatenate(([0], ends))[np.minimum(start, n)]
    offsets = chunks[chunk] + (ends - sizes) - before[chunk]
    total = int(steps.sum())
    keys = np.ones(n, bool)
    if b"stss" in b:
        keys[:] = False
        keys[_table(b[b"stss"], ">u4").astype(np.int64) - 1] = True
    return Head(int(width), int(height), offsets, sizes, (np.cumsum(steps) - steps) / scale, keys, float(total / scale), n * scale / total if total else None)


def head_of(file, length: int) -> Head | None:
    """The head of an open file, or null where it can't be read: no container, cut off, in fragments, or without pictures."""
    try:
        for kind, body in boxes(moov_of(file, length)):
            if kind == b"trak" and (got := track_of(body)) is not None:
                return got
    except (ValueError, KeyError, IndexError, struct.error):
        pass
    return None


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """HEADS of the files below path: a row for each, with nulls where a head can't be read.

    Spark lists the files; tasks read only heads. duration is what the frames take, fps frames by duration.
    """
    reachable(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*ENDINGS))
    names = [f.split(" ")[0] for f in HEADS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, length in zip(pdf["path"], pdf["length"], strict=True):
                fs, at = opened(file)
                with fs.open_input_file(at) as f:
                    h = head_of(f, length)
                out.append((file, length) + ((len(h.sizes), h.fps, h.duration, h.width, h.height) if h else (None,) * 5))
            got = pd.DataFrame(out, columns=names)
            yield got.astype({"frames": "Int64", "fps": "Float64", "duration": "Float64", "width": "Int32", "height": "Int32"})

    return files.repartition(max(1, min(files.rdd.getNumPartitions() * 4, 10_000)), "path").mapInPandas(run, HEADS)


def sampled(total: int, native: float, fps: float | None, most: int | None) -> np.ndarray:
    """Frames of a sampling, as sources.video.sample_plan() has them."""
    step = native / fps if fps else 1.0
    out = np.minimum((np.arange(int(np.ceil(total / step))) * step).astype(np.int64), total - 1)
    if most is not None and len(out) > most:
        out = (np.arange(most) * (total - 1) / max(1, most - 1)).astype(np.int64)
    return np.unique(out)


class Range(InputPartition):
    """Ranges of bytes of files: [(path, length, from, to)]."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.fps = float(options["fps"]) if options.get("fps") else None
        self.most = int(options["most"]) if options.get("most") else None
        self.split = int(options.get("split", SPLIT))
        self.paths: set[str] | None = None
        self.frames: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("path",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = names if self.paths is None else self.paths & names
            elif f.attribute == ("frame",) and isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.frames.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs as P

        fs, root = opened(self.path)
        uri = self.path[: len(self.path) - len(root)]
        uri = "file:" if uri in ("", "file:", "file://") else uri  # as Spark names local files
        found = fs.get_file_info(root)
        every = fs.get_file_info(P.FileSelector(root, recursive=True)) if found.type == P.FileType.Directory else [found]
        out, held, size = [], [], 0
        for f in sorted(every, key=lambda f: f.path):
            name = f"{uri}{f.path}"
            if f.type != P.FileType.File or not f.path.lower().endswith(ENDINGS) or (self.paths is not None and name not in self.paths):
                continue
            for lo in range(0, max(f.size, 1), self.split):
                part = (name, f.size, lo, min(lo + self.split, max(f.size, 1)))
                if size and size + part[3] - part[2] > self.split:
                    out.append(Range(held))
                    held, size = [], 0
                held.append(part)
                size += part[3] - part[2]
        return [*out, Range(held)] if held or not out else out

    def wanted(self, frames: np.ndarray) -> np.ndarray:
        """Which frames pass the filters."""
        ok = np.ones(len(frames), bool)
        test = {"GreaterThan": np.greater, "GreaterThanOrEqual": np.greater_equal, "LessThan": np.less, "LessThanOrEqual": np.less_equal, "EqualTo": np.equal}
        for name, value in self.frames:
            ok &= np.isin(frames, list(value)) if name == "In" else test[name](frames, value)
        return ok

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("frame", pa.int32()), ("position", pa.int32()), ("ts", pa.float64()), ("key", pa.bool_()), ("image", pa.binary())])
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

        for path, length, lo, hi in partition.parts:
            fs, at = opened(path)
            with fs.open_input_file(at) as file:
                h = head_of(file, length)
                if h is None or not len(h.sizes):
                    continue
                frames = sampled(len(h.sizes), h.fps or 1.0, self.fps, self.most)
                places = np.arange(len(frames))
                ok = self.wanted(frames) & (h.offsets[frames] >= lo) & (h.offsets[frames] < hi)
                for k, place in zip(frames[ok].tolist(), places[ok].tolist(), strict=True):
                    file.seek(int(h.offsets[k]))
                    image = file.read(int(h.sizes[k]))
                    if len(image) < h.sizes[k]:
                        continue  # cut off
                    held.append((path, k, place, float(h.times[k]), bool(h.keys[k]), image))
                    size += len(image) + 64
                    if size >= BATCH:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class FrameSource(DataSource):
    """spark.read.format("frames"): FRAMES of the files below path (FRAMES).

    Options: path, a file or a folder; fps and most, a sampling as in sources.video.sample_plan(), position then counts the sampled
    frames of a file; split, bytes of a partition. Files that can't be read have no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def read_frames(spark: SparkSession, path: str, fps: float | None = None, most: int | None = None, split: int = SPLIT) -> DataFrame:
    """FRAMES of a file or folder; filters on path and frame are pushed into the source."""
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    options = {"split": str(split)} | ({"fps": str(fps)} if fps else {}) | ({"most": str(most)} if most is not None else {})
    return spark.read.format("frames").options(**options).load(path)


def _box(kind: bytes, *bodies: bytes) -> bytes:
    body = b"".join(bodies)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def head_box(offsets: list[int], sizes: list[int], steps: list[int], scale: int, width: int, height: int, keys: list[int] | None = None) -> bytes:
    """A box moov with one track of pictures: places and sizes of its frames, how long each is shown (in scale parts of a
    second), and the numbers (from 1) of those that stand alone, if not all."""
    numbers = lambda values, kind: np.asarray(values, kind).tobytes()
    total, n = sum(steps), len(sizes)
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = struct.pack(">I4s6xHHH3IHHIIIH32xHh", 86, b"jpeg", 1, 0, 0, 0, 0, 0, width, height, 0x480000, 0x480000, 0, 1, 24, -1)
    tables = [
        _box(b"stsd", struct.pack(">II", 0, 1), entry),
        _box(b"stts", struct.pack(">II", 0, n), numbers([x for s in steps for x in (1, s)], ">u4")),
        _box(b"stsc", struct.pack(">II", 0, 1 if n else 0), struct.pack(">III", 1, 1, 1) if n else b""),
        _box(b"stsz", struct.pack(">III", 0, 0, n), numbers(sizes, ">u4")),
        _box(b"co64", struct.pack(">II", 0, n), numbers(offsets, ">u8")),
    ] + ([_box(b"stss", struct.pack(">II", 0, len(keys)), numbers(keys, ">u4"))] if keys is not None else [])
    mdia = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, scale, total & 0xFFFFFFFF, 0x55C4, 0)), _box(b"hdlr", struct.pack(">II4s12xB", 0, 0, b"vide", 0)), _box(b"minf", _box(b"stbl", *tables)))
    tkhd = _box(b"tkhd", struct.pack(">IIIIII8xHHHH", 3, 0, 0, 1, 0, total & 0xFFFFFFFF, 0, 0, 0, 0), unity, struct.pack(">II", width << 16, height << 16))
    mvhd = _box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, scale, total & 0xFFFFFFFF, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2))
    return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def write_clips(frames: DataFrame, path: str) -> DataFrame:
    """(video_id, file): a container for each video of frames (video_id, frame_idx, image, step int, scale int, width int, height int).

    A frame is shown for step scale-ths of a second; scale, width and height are those of the video's first frame. Null
    pictures are empty. Frames stream through a task in their order and go to the file one by one, the head last, so of a
    video only the tables are held. A file appears under its name when it is whole; a task that runs again replaces it.
    """
    spark = frames.sparkSession
    reachable(spark)
    rows = frames.select("video_id", "frame_idx", F.coalesce("image", F.lit(b"")).alias("image"), "step", "scale", "width", "height")
    rows = rows.where("video_id IS NOT NULL").repartition("video_id").sortWithinPartitions("video_id", "frame_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, out, at, tables, shape = None, None, 0, [], None

        def finished() -> pd.DataFrame:
            offsets, sizes, steps = zip(*tables, strict=True)
            out.write(head_box(list(offsets), list(sizes), list(steps), *shape))
            out.close()
            fs.move(f"{root}/.{now}-{attempt}", f"{root}/{now}.mp4")
            return pd.DataFrame({"video_id": [now], "file": [f"{path}/{now}.mp4"]})

        for pdf in batches:
            for video, image, step, scale, width, height in pdf[["video_id", "image", "step", "scale", "width", "height"]].itertuples(index=False, name=None):
                if video != now:
                    if out is not None:
                        yield finished()
                    now, tables, shape = video, [], (int(scale), int(width), int(height))
                    out = fs.open_output_stream(f"{root}/.{now}-{attempt}")
                    start = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")
                    out.write(start)
                    at = len(start)
                out.write(struct.pack(">I4s", 8 + len(image), b"mdat") + image)
                tables.append((at + 8, len(image), int(step)))
                at += 8 + len(image)
        if out is not None:
            yield finished()

    return rows.mapInPandas(run, "video_id long, file string")
