"""Containers built by hand and by the sink, the frame source, and encoding."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.models import StandIn
from reelgraph.operators import encode as E
from reelgraph.sources import frames as R
from reelgraph.sources import video as V


def boxed(kind, *bodies):
    body = b"".join(bodies)
    return struct.pack(">I", 8 + len(body)) + kind + body


def by_hand(pictures, chunks, scale=600, step=24, version=0, handler=b"vide", moov_first=False, wide=False):
    """A container as its description has it: chunks lists how many frames each chunk holds."""
    media = b"".join(pictures)
    start = 16 + (16 if wide else 8)
    table = b"".join(struct.pack(">III", k + 1, n, 1) for k, n in enumerate(chunks) if k == 0 or chunks[k - 1] != n)
    count = len(table) // 12
    times = b"".join(struct.pack(">Q" if version else ">I", x) for x in (0, 0))
    length = struct.pack(">Q" if version else ">I", step * len(pictures))

    def moov(shift):
        at, places, k = shift, [], 0
        for n in chunks:
            places.append(at)
            at += sum(len(p) for p in pictures[k : k + n])
            k += n
        stbl = boxed(b"stbl", boxed(b"stts", struct.pack(">IIII", 0, 1, len(pictures), step)), boxed(b"stsc", struct.pack(">II", 0, count), table), boxed(b"stsz", struct.pack(">III", 0, 0, len(pictures)), b"".join(struct.pack(">I", len(p)) for p in pictures)), boxed(b"stco", struct.pack(">II", 0, len(places)), b"".join(struct.pack(">I", p) for p in places)), boxed(b"stss", struct.pack(">III", 0, 1, 1)))
        mdhd = boxed(b"mdhd", bytes([version, 0, 0, 0]), times, struct.pack(">I", scale), length, bytes(4))
        tkhd = boxed(b"tkhd", bytes([version, 0, 0, 7]), times, struct.pack(">II", 1, 0), length, bytes(8 + 8 + 36), struct.pack(">II", 640 << 16, 360 << 16))
        sound = boxed(b"trak", boxed(b"mdia", boxed(b"hdlr", bytes(8), b"soun", bytes(13))))
        return boxed(b"moov", sound, boxed(b"trak", tkhd, boxed(b"mdia", mdhd, boxed(b"hdlr", bytes(8), handler, bytes(13)), boxed(b"minf", stbl))))

    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(media)) + media if wide else boxed(b"mdat", media)
    ftyp = boxed(b"ftyp", b"isom", bytes(4))
    return ftyp + moov(start + len(moov(0))) + mdat if moov_first else ftyp + mdat + moov(start)


PICTURES = [bytes([k]) * (k + 1) for k in range(10)]


@pytest.mark.parametrize("version", [0, 1])
@pytest.mark.parametrize("chunks", [[10], [3, 3, 3, 1], [1] * 10, [2, 2, 6]])
@pytest.mark.parametrize("first", [False, True])
def test_heads(version, chunks, first):
    raw = by_hand(PICTURES, chunks, version=version, moov_first=first, wide=version == 1)
    h = R.head_of(io.BytesIO(raw), len(raw))
    assert (h.width, h.height, h.duration, h.fps) == (640, 360, 0.4, 25.0)
    assert [raw[a : a + n] for a, n in zip(h.offsets.tolist(), h.sizes.tolist(), strict=True)] == PICTURES
    assert h.times.tolist() == pytest.approx([k / 25 for k in range(10)]) and h.keys.tolist() == [True] + [False] * 9


def test_heads_that_cannot_be_read():
    raw = by_hand(PICTURES, [10])
    for cut in range(0, len(raw)):
        assert R.head_of(io.BytesIO(raw[:cut]), cut) is None
    sound = by_hand(PICTURES, [10], handler=b"soun")
    wrong = by_hand(PICTURES, [9])
    for bad in (b"", b"RIFF" + bytes(50), sound, wrong, bytes(100)):
        assert R.head_of(io.BytesIO(bad), len(bad)) is None


def test_frames_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.mp4").write_bytes(by_hand(PICTURES, [3, 3, 3, 1]))
    (tmp_path / "sub" / "b.MOV").write_bytes(by_hand(PICTURES[:5], [5], moov_first=True))
    (tmp_path / "cut.mp4").write_bytes(by_hand(PICTURES, [10])[:-5])
    (tmp_path / "other.txt").write_bytes(b"x")
    at = f"file://{tmp_path}"
    heads = {r.path.rsplit("/", 1)[1]: r for r in R.read_heads(spark, at).collect()}
    assert {k: (r.frames, r.fps, r.width) for k, r in heads.items()} == {"a.mp4": (10, 25.0, 640), "b.MOV": (5, 25.0, 640), "cut.mp4": (None, None, None)}
    for split in (1 << 20, 16):  # many ranges of bytes: each frame is in one
        got = sorted((r.path.rsplit("/", 1)[1], r.frame, r.position, bytes(r.image)) for r in R.read_frames(spark, at, split=split).collect())
        assert got == [("a.mp4", k, k, p) for k, p in enumerate(PICTURES)] + [("b.MOV", k, k, p) for k, p in enumerate(PICTURES[:5])]
    df = R.read_frames(spark, at).where("frame >= 3 AND frame < 6 AND frame IN (2, 4, 5) AND path LIKE '%a.mp4'")
    assert sorted(r.frame for r in df.collect()) == [4, 5]
    name = next(r.path for r in heads.values() if r.frames == 5)
    one = R.read_frames(spark, at).where(F.col("path") == name)
    assert one.count() == 5 and one.rdd.getNumPartitions() == 1
    assert R.read_frames(spark, f"{at}/a.mp4").count() == 10


def test_pushed_filters_read_few_bytes(tmp_path):
    """One frame in a hundred reads one byte in a hundred, besides the head."""
    pictures = [bytes([k % 251]) * 1000 for k in range(400)]
    raw = by_hand(pictures, [50] * 8)
    (tmp_path / "v.mp4").write_bytes(raw)
    r = R.FrameReader({"path": f"{tmp_path}"})
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

    left = list(r.pushFilters([GreaterThanOrEqual(("frame",), 100), LessThan(("frame",), 104), IsNotNull(("frame",))]))
    assert [type(f).__name__ for f in left] == ["IsNotNull"]
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

    class Files:
        def open_input_file(self, at):
            return Counting(raw)

    opened, R.opened = R.opened, lambda path: (Files(), path)
    try:
        rows = [x for b in r.read(R.Range([("v", len(raw), 0, len(raw))])) for x in b.to_pylist()]
    finally:
        R.opened = opened
    assert [x["frame"] for x in rows] == [100, 101, 102, 103] and all(x["image"] == pictures[x["frame"]] for x in rows)
    head = len(raw) - 400_000
    assert sum(read) <= 4000 + head + 64


def test_sampling_agrees_with_the_plan(spark):
    cases = [(n, native, fps, most) for n in (1, 7, 100, 333) for native in (24.0, 29.97) for fps in (1.0, 2.0, 30.0) for most in (None, 1, 5)]
    for n, native, fps, most in cases:
        want = V.sample_plan(spark.createDataFrame([(1, n, native)], "video_id long, total int, native_fps double"), fps, most)
        assert R.sampled(n, native, fps, most).tolist() == sorted(r.frame for r in want.collect())


def test_clips_that_are_written_are_read(spark, tmp_path):
    rows = [(v, k, bytes([v, k]) * (k + v), 40 + v, 1000, 32, 16) for v in (1, 2, 3) for k in range(6)] + [(3, 6, None, 43, 1000, 32, 16), (None, 0, b"x", 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx int, image binary, step int, scale int, width int, height int").repartition(4)
    files = R.write_clips(df, f"file://{tmp_path}/clips").collect()
    assert sorted(r.video_id for r in files) == [1, 2, 3] and len(list((tmp_path / "clips").glob("*"))) == 3
    got = sorted((int(r.path.rsplit("/", 1)[1][:-4]), r.frame, bytes(r.image), round(r.ts, 6)) for r in R.read_frames(spark, f"file://{tmp_path}/clips").collect())
    assert got == sorted((v, k, i or b"", round(k * s / 1000, 6)) for v, k, i, s, *_ in rows if v)
    heads = {r.frames: (r.width, r.height, round(r.duration, 6)) for r in R.read_heads(spark, f"file://{tmp_path}/clips").collect()}
    assert heads == {6: (32, 16, 0.252), 7: (32, 16, 0.301)} or set(heads) == {6, 7}
    v = E.encode_videos(spark, f"file://{tmp_path}/clips", StandIn, fps=5.0).collect()
    assert {(r.position, r.frame) for r in v} >= {(0, 0), (1, 4)} and all(len(r.v) == 64 for r in v)


def test_frames_are_encoded_in_batches(spark):
    class Counted(StandIn):
        def encode_images(self, images):
            if len(images) > 32:
                raise ValueError("too many")
            return np.stack([[len(x), 3.0, 0.0] if x else [0.0, 0.0, 0.0] for x in images])

    factory = lambda: Counted()
    rows = [(k, bytes(k % 5) if k % 7 else None, "x") for k in range(205)]
    df = spark.createDataFrame(rows, "frame_idx int, image binary, v string").repartition(2)
    got = {r.frame_idx: r.v for r in E.encode_frames(df.drop("v").withColumn("v", F.lit("x")), factory).collect()}
    for k, image, _ in rows:
        if image is None:
            assert got[k] is None
        elif not image:
            assert got[k] == [0.0, 0.0, 0.0]
        else:
            n = (len(image) ** 2 + 9) ** 0.5
            assert got[k] == pytest.approx([len(image) / n, 3 / n, 0])
    assert E.encode_frames(df.limit(0), factory).count() == 0
    texts = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [r.u is None for r in E.encode_texts(texts, StandIn).collect()] == [False, True]


def test_batches_are_filled_across_others():
    import pyarrow as pa

    parts = [pa.record_batch({"x": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 40), (40, 41), (41, 70))]
    got = list(E.refilled(iter(parts), 32))
    assert [t.num_rows for t in got] == [32, 32, 6] and [x for t in got for x in t.column("x").to_pylist()] == list(range(70))
