"""Settings, the client of models, sources of videos, questions and files, and the command line."""

import json

import pytest

from reelgraph import app
from reelgraph.models import client as C
from reelgraph.models import read_json
from reelgraph.settings import Endpoint, Settings, from_environment
from reelgraph.sources import video as R


def test_settings_from_the_environment():
    s = from_environment({"REELGRAPH_FPS": "2", "REELGRAPH_VISUAL_SHARE": "7", "REELGRAPH_TIMELINE_FRAMES": "-1", "REELGRAPH_MODEL_RELEVANCE": " Yes", "REELGRAPH_SHOW_EVIDENCE": "off", "REELGRAPH_BASE_STEPS": "many", "REELGRAPH_VISION_API_KEY": "sesame", "REELGRAPH_TEXT_MODEL": "m", "REELGRAPH_VISION_PICTURES_PER_CALL": "0"})
    assert (s.fps, s.visual_share, s.timeline_frames, s.model_relevance, s.show_evidence, s.base_steps) == (2.0, 1.0, 0, True, False, 10)
    assert s.text.api_key == "sesame" and s.text.model == "m" and s.vision.pictures_per_call == 1 and "sesame" not in repr(s.vision)
    assert from_environment({}) == Settings()


def client(replies, **more):
    calls = []

    def send(model, messages, options):
        calls.append((model, messages, options))
        out = replies.pop(0)
        if isinstance(out, Exception):
            raise out
        return out

    waits = []
    c = C.Client(Endpoint(model="qwen3vl-x", attempts=3, **more), send, waits.append, lambda: 0.5)
    return c, calls, waits


def test_attempts_and_what_they_used():
    c, calls, waits = client([RuntimeError("Connection error"), RuntimeError("503"), {"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "prompt_tokens_details": {"image_tokens": 2}}}])
    assert c.chat([{"role": "user", "content": "x"}]) == "hi" and len(calls) == 3 and waits == [1.0, 2.0]
    assert c.usage()["calls"] == c.usage()["text_calls"] == 1 and c.usage()["prompt_tokens"] == 3 and c.usage()["image_tokens"] == 2
    c.reset_usage()
    assert set(c.usage().values()) == {0}


def test_errors_of_the_provider():
    assert client([RuntimeError("data_inspection_failed")])[0].chat([]) == C.FILTERED
    assert client([RuntimeError("Unable to reach the model provider")] * 3)[0].chat([]) == C.UNREACHABLE
    c, calls, _ = client([RuntimeError("model_not_found"), "ok"])
    assert c.chat([]) == "ok" and c.model == "qwen3-vl-x" and calls[1][0] == "qwen3-vl-x"
    with pytest.raises(RuntimeError, match="bad key"):
        client([RuntimeError("bad key")])[0].chat([])


def test_pictures_and_json():
    c, calls, _ = client(["x"], pictures_per_call=2)
    assert c.chat_with_pictures("p", [b"a", b"b", b"c", b"d"], "s") == "x" and c.usage()["images_sent"] == 2
    parts = calls[0][1][1]["content"]
    assert [p["type"] for p in parts] == ["image_url", "image_url", "text"] and parts[1]["image_url"]["url"].endswith("Yw==")
    assert client(["no", "```json\n{\"a\": 1}\n```"])[0].chat_json("p") == {"a": 1}
    with pytest.raises(ValueError, match="JSON"):
        client(["no"] * 3)[0].chat_json("p")
    assert read_json('x {"a":{"b":1}} y') == {"b": 1}
    assert [C.content(r) for r in ("s", None, {"content": "c"}, {"choices": [{"text": "t"}]})] == ["s", "", "c", "t"]


def test_sampling_plans(spark):
    v = spark.createDataFrame([(1, 100, 25.0), (2, 1, 30.0), (3, 0, 30.0)], "video_id long, total long, native_fps double")
    plan = [(r.video_id, r.frame, r.ts) for r in R.sample_plan(v).orderBy("video_id", "frame").collect()]
    assert plan == [(1, 0, 0.0), (1, 25, 1.0), (1, 50, 2.0), (1, 75, 3.0), (2, 0, 0.0)]
    assert [r.frame for r in R.sample_plan(v, most=3).where("video_id = 1").orderBy("frame").collect()] == [0, 49, 99]
    from pyspark.sql import functions as F

    assert [r.frame for r in R.clip_plan(v, F.lit(3.5), 1.0).where("video_id = 1").orderBy("frame").collect()] == [62, 87]


def test_lazy_handles(spark, tmp_path):
    f = spark.createDataFrame([(1, 10 * i, f"i{i}") for i in range(5)] + [(2, 0, "x")], "video_id long, frame_idx int, image string")
    lazy = R.LazyFrames(f, 1)
    assert len(lazy) == 5 and [r.image for r in lazy.get_batch([3, 1, 9]).collect()] == ["i1", "i3"]
    assert [r.image for r in lazy[-2:].collect()] == ["i3", "i4"] and lazy[-1].first().image == "i4"
    with pytest.raises(IndexError):
        lazy[5]
    (tmp_path / "a.png").write_bytes(b"A")
    paths = [f"file://{tmp_path}/a.png", f"file://{tmp_path}/gone.png"]
    images = R.LazyImages(spark, paths)
    assert len(images) == 2 and [bytes(r.content) for r in images.get_batch([0, 1, 7]).collect()] == [b"A"] and bytes(images[0].first().content) == b"A"
    with pytest.raises(IndexError):
        images[1]
    decode = lambda raw: iter([(0, 0.0, raw), (1, 0.5, raw * 2)])
    assert sorted(bytes(r.image) for r in R.decoded(images[0], decode).collect()) == [b"A", b"AA"]


def test_question_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("video_id\tquestion\toptions\tanswer\nv1\tWhat?\t['A. x', 'B. y']\tA\nv2\t\t\t\n")
    rows = R.questions_file(spark, f"file://{tmp_path}/q.tsv").orderBy("row").collect()
    assert [(r.row, r.video, r.query, r.truth) for r in rows] == [(0, "v1", "What? Options: ['A. x', 'B. y']", "A"), (1, "v2", " Options: ", "")]
    (tmp_path / "p.tsv").write_text("question\nWho?\n")
    assert R.questions_file(spark, f"file://{tmp_path}/p.tsv").first().video == "sample_0"
    for name in ("v1.avi", "v1.mp4", "sub/v2.mkv", "sub/v1.mp4", "v3.txt"):
        (tmp_path / "videos" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "videos" / name).write_bytes(b"x")
    wanted = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "video string")
    got = {r.video: r.path and r.path.split("/videos/")[1] for r in R.video_files(spark, f"file://{tmp_path}/videos", wanted).collect()}
    assert got == {"v1": "v1.mp4", "v2": "sub/v2.mkv", "v3": None}


def test_transcripts(spark):
    def speak(path):
        if path == "bad":
            raise OSError(path)
        yield 0.0, 1.0, " hello "

    v = spark.createDataFrame([(1, "good"), (2, "bad")], "video_id long, path string")
    assert [tuple(r) for r in R.transcripts(spark, None, transcribe=speak, videos=v).collect()] == [(1, 0.0, 1.0, "hello")]
    assert R.transcripts(spark, None).count() == 0 == R.transcripts(spark, "nowhere", wanted=False).count()


def test_command_line(spark, tmp_path):
    rows = [(1, i, [float(i % 2), 1.0] + [0.0] * 62) for i in range(20)]
    spark.createDataFrame(rows, "video_id long, frame_idx int, v array<double>").write.parquet(f"{tmp_path}/frames")
    out = app.main(["--frames", f"{tmp_path}/frames", "--video_id", "1", "--question", "Who?", "--options", "['A. x', 'B. y']", "--ground_truth", "A", "--output_dir", f"{tmp_path}/out", "--models", "reelgraph.models:StandIn"], spark)
    assert out.first().options == ["A", "B"]  # those of the list
    assert len(json.loads(spark.read.text(f"{tmp_path}/out/answers").first().value)["frames"]) > 0
    with pytest.raises(SystemExit):
        app.arguments(["--frames", "x"])
