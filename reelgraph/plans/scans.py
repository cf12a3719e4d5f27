"""Queries of sampling plans, clips, point reads, belief snapshots and whole searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgraph.models import StandIn
from reelgraph.operators import encode as E
from reelgraph.operators import selection as C
from reelgraph.operators import solve as A
from reelgraph.plans import FRAMES, query, r6
from reelgraph.plans.selection import BELIEF, CURVE, _belief, _curve, _seen
from reelgraph.settings import Settings
from reelgraph.sources import frames as M
from reelgraph.sources import tables as S
from reelgraph.sources import video as R
from reelgraph.streaming import sessions
from reelgraph.workers import shared_folder

_VIDEOS = "videos AS (SELECT doc_id AS video_id, n_chars AS total, (20 + doc_id % 11)::DOUBLE AS native FROM documents)"


def _videos(spark, d):
    """A video for each document, of as many frames as that has characters, at 20 to 30 of them a second."""
    return S.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("n_chars").alias("total"), (F.col("doc_id") % 11 + 20).cast("double").alias("native_fps"))


@query(f"WITH {_VIDEOS} SELECT DISTINCT video_id, frame, round(frame / native, 6) AS ts FROM (SELECT video_id, native, least(unnest([floor(i * (native / 2))::INT FOR i IN range(0, ceil(total / (native / 2))::INT)]), total - 1)::INT AS frame FROM videos WHERE total > 0)")
def sample_plan(spark, d):
    return R.sample_plan(_videos(spark, d), 2.0).select("video_id", "frame", F.round("ts", 6).alias("ts"))


@query(f"WITH {_VIDEOS} SELECT DISTINCT video_id, CASE WHEN ceil(total / (native / 2))::INT > 50 THEN floor(i * (total - 1) / 49.0)::INT ELSE least(floor(i * (native / 2))::INT, total - 1)::INT END AS frame FROM (SELECT *, unnest(range(0, least(50, ceil(total / (native / 2))::INT))) AS i FROM videos WHERE total > 0)")
def sample_plan_cut(spark, d):
    """At most 50 frames."""
    return R.sample_plan(_videos(spark, d), 2.0, 50).select("video_id", "frame")


@query(f"WITH {_VIDEOS}, c AS (SELECT *, (video_id % 9)::DOUBLE AS mid FROM videos WHERE total > 0), b AS (SELECT *, floor(greatest(0, mid - 2) * native)::INT AS a, floor(least(total / native, mid + 2) * native)::INT AS z FROM c) SELECT DISTINCT video_id, least(floor(a + unnest([i FOR i IN range(0, greatest(ceil((z - a) / (native / 4))::INT, 0))]) * (native / 4))::INT, total - 1)::INT AS frame FROM b")
def clip_plan(spark, d):
    return R.clip_plan(_videos(spark, d), (F.col("video_id") % 9).cast("double"), 2.0, 4.0).select("video_id", "frame")


@query(f"WITH {FRAMES} SELECT f.video_id, f.frame_idx, label FROM frames f JOIN (SELECT DISTINCT user_id % 20 AS video_id, (event_id % 100)::INT AS frame_idx FROM events WHERE event_type = 'click') USING (video_id, frame_idx)")
def frames_at(spark, d):
    e = S.read(spark, d, "events").where("event_type = 'click'")
    return R.frames_at(S.frames(spark, d), e.select((F.col("user_id") % 20).alias("video_id"), (F.col("event_id") % 100).cast("int").alias("frame_idx"))).select("video_id", "frame_idx", "label")


@query(f"WITH {FRAMES} SELECT video_id, count(*)::BIGINT AS total_frames, 2.0::DOUBLE AS fps, count(*) / 2.0::DOUBLE AS duration FROM frames GROUP BY 1")
def video_info(spark, d):
    return R.video_info(S.frames(spark, d), 2.0)


@query(f"WITH RECURSIVE {BELIEF} SELECT video_id, step, frame_idx, round(mu, 6) + 0.0 AS mu, round(sigma, 6) + 0.0 AS sigma FROM b")
def belief_history(spark, d):
    start = _curve(spark, d).select("video_id", "frame_idx", F.col("x").alias("mu"), F.lit(1.0).alias("sigma"))
    return C.belief_history(start, _seen(spark, d)).select("video_id", "step", "frame_idx", r6("mu").alias("mu"), r6("sigma").alias("sigma"))


@query(f"WITH RECURSIVE {BELIEF}, last AS (SELECT video_id, arg_max(relevance, step) AS last FROM seen GROUP BY 1) SELECT video_id, round(max(mu), 6) AS confidence, coalesce(any_value(last) > 0.85 AND round(max(mu), 9) > 0.5, false) AS stop FROM b3 LEFT JOIN last USING (video_id) GROUP BY 1")
def belief_confidence(spark, d):
    return C.confidence(_belief(spark, d), _seen(spark, d), 0.85, 0.5).select("video_id", r6("confidence").alias("confidence"), "stop")


@query(f"WITH RECURSIVE {BELIEF}, p0 AS (SELECT DISTINCT video_id, []::INT[] AS used FROM b3)"
       + "".join(f", p{k} AS (SELECT video_id, list_append(used, arg_max(frame_idx, (round(mu, 9), -frame_idx))) AS used FROM p{k - 1} JOIN b3 USING (video_id) WHERE len(list_filter(used, lambda u: abs(u - frame_idx) < 10)) = 0 GROUP BY video_id, used)" for k in range(1, 5))
       + " SELECT video_id, unnest(used) AS frame_idx FROM p4")
def belief_peaks(spark, d):
    return C.find_peaks(_belief(spark, d).select("video_id", "frame_idx", F.col("mu").alias("x")), 4, 10)


@query()
def spectral_anchors(spark, d):
    return C.spectral_anchors(S.frames(spark, d), 8)


def stand_in():
    return StandIn()


@query()
def solve(spark, d):
    """Every conversation, all its turns, is a question about a video; deterministic stand-ins answer."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    q = S.read(spark, d, "conversations").groupBy("conv_id").agg(said.alias("said"))
    q = q.select((F.col("conv_id") % 20).alias("video_id"), F.col("conv_id").alias("question_id"), F.concat("said", F.lit("\nA. "), F.element_at(F.split("said", " "), 1), F.lit(" seen\nB. nothing\nC. Other things")).alias("question"))
    found = A.solve(S.frames(spark, d), q, stand_in, given=Settings(threshold=0.0, least_frames=10))
    return found.select("video_id", "question_id", "answer", "fallback", "segments", "frames", F.size("steps").alias("n_steps"))


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL), c AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, (epoch_us(min(ts)) // 1000)::BIGINT AS start_ms, (epoch_us(max(ts) + INTERVAL 6 HOUR) // 1000)::BIGINT AS end_ms, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM c GROUP BY user_id, k""")
def event_sessions(spark, d):
    """An extension: runs of a user's events."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return sessions(S.read(spark, d, "events"), "6 hours").select("user_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "n", F.round("total", 4).alias("total"))


_CLIPS = "c AS (SELECT conv_id AS video_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS frame, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL), v AS (SELECT video_id, count(*) AS total, (20 + video_id % 11)::DOUBLE AS step FROM c GROUP BY 1)"


def _clips(spark, d):
    """A folder of containers: a video for each conversation, a frame for each turn, the turn's text as its picture."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = S.read(spark, d, "conversations").withColumn("frame_idx", F.row_number().over(w) - 1)
    size = lambda k: (F.col("conv_id") % k + 1) * 16
    rows = t.select(F.col("conv_id").alias("video_id"), "frame_idx", F.encode("text", "UTF-8").alias("image"), (F.col("conv_id") % 11 + 20).cast("int").alias("step"), F.lit(600).alias("scale"), size(4).cast("int").alias("width"), size(3).cast("int").alias("height"))
    path = shared_folder(spark, "clips")
    M.write_clips(rows, path).write.format("noop").mode("overwrite").save()
    return path


def _video():
    return F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("long").alias("video_id")


@query(f"WITH {_CLIPS} SELECT video_id, total AS frames, round(600 / step, 6) AS fps, round(total * step / 600, 6) AS duration, (16 * (video_id % 4 + 1))::INT AS width, (16 * (video_id % 3 + 1))::INT AS height FROM v")
def container_heads(spark, d):
    h = M.read_heads(spark, _clips(spark, d))
    return h.select(_video(), "frames", F.round("fps", 6).alias("fps"), F.round("duration", 6).alias("duration"), "width", "height")


@query(f"WITH {_CLIPS}, p AS (SELECT DISTINCT video_id, least(floor(unnest(range(0, ceil(total / (60 / step))::INT)) * (60 / step))::INT, total - 1)::INT AS frame FROM v) SELECT video_id, frame, (row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1)::INT AS position, round(frame * step / 600, 6) AS ts, octet_length(encode(text))::INT AS n_bytes, md5(text) AS digest FROM p JOIN c USING (video_id, frame) JOIN v USING (video_id)")
def container_sample(spark, d):
    """Ten frames a second of each container."""
    f = M.read_frames(spark, _clips(spark, d), fps=10.0)
    return f.select(_video(), "frame", "position", F.round("ts", 6).alias("ts"), F.length("image").alias("n_bytes"), F.md5("image").alias("digest"))


@query(f"WITH {_CLIPS} SELECT video_id, frame, md5(text) AS digest FROM c WHERE frame >= 2 AND frame < 5")
def container_range(spark, d):
    """A range of frames, by filters that the source takes over."""
    f = M.read_frames(spark, _clips(spark, d)).where("frame >= 2 AND frame < 5")
    return f.select(_video(), "frame", F.md5("image").alias("digest"))


@query("""WITH b AS (SELECT doc_id, ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT % 64 AS k FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, k::INT AS k, count(*)::DOUBLE AS n FROM b GROUP BY ALL)
SELECT doc_id, k, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM n""")
def encoded_frames(spark, d):
    """Vectors of pictures (the bytes of texts), by the stand-in: their parts above 0."""
    t = S.read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("image"))
    return E.encode_frames(t, stand_in).select("doc_id", F.posexplode("v").alias("k", "x")).where("x > 0").select("doc_id", "k", F.round("x", 6).alias("x"))


@query(f"""WITH {_CLIPS}, p AS (SELECT DISTINCT video_id, least(floor(unnest(range(0, ceil(total / (60 / step))::INT)) * (60 / step))::INT, total - 1)::INT AS frame FROM v), b AS (SELECT video_id, frame, ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT % 64 AS k FROM p JOIN c USING (video_id, frame)), n AS (SELECT video_id, frame, k::INT AS k, count(*)::DOUBLE AS n FROM b GROUP BY ALL)
SELECT video_id, frame, k, round(n / sqrt(sum(n * n) OVER (PARTITION BY video_id, frame)), 6) AS x FROM n""")
def encoded_videos(spark, d):
    """From containers to the vectors of sampled frames."""
    v = E.encode_videos(spark, _clips(spark, d), stand_in, fps=10.0)
    return v.select(_video(), "frame", F.posexplode("v").alias("k", "x")).where("x > 0").select("video_id", "frame", "k", F.round("x", 6).alias("x"))
