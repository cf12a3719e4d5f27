"""Queries of greedy selection, belief updates and fused channels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.functions import vectors as V
from reelgraph.operators import graph as G
from reelgraph.operators import selection as C
from reelgraph.plans import FRAMES, KEYS, PRIOR, SQL, STEPS, TOKENS, nodes_of, query, r6
from reelgraph.sources import tables as S

CHOSEN = STEPS + ", n0 AS MATERIALIZED (SELECT video_id, node, round(f, 9) AS f FROM f7)" + "".join(
    f", s{k} AS MATERIALIZED (SELECT video_id, {k} AS rank, arg_max(node, (f, -node)) AS node FROM n{k - 1} WHERE f > 0 GROUP BY 1)"
    f", n{k} AS MATERIALIZED (SELECT n.video_id, n.node, CASE WHEN n.node = s.node THEN -1e9 WHEN e.i IS NOT NULL THEN n.f * 0.2 ELSE n.f END AS f FROM n{k - 1} n LEFT JOIN s{k} s ON s.video_id = n.video_id LEFT JOIN edges e ON e.video_id = n.video_id AND e.i = s.node AND e.j = n.node AND e.w > 0)"
    for k in range(1, 9)
) + ", chosen AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, 9)) + ")"
SQL["nms"] = f"WITH RECURSIVE {CHOSEN} SELECT * FROM chosen"
SQL["evidence_frames"] = f"WITH RECURSIVE {CHOSEN} SELECT DISTINCT video_id, unnest(CASE WHEN e - s + 1 <= 4 THEN range(s, e + 1)::INT[] ELSE [floor(s + i * (e - s + 1) / 4)::INT FOR i IN range(0, 4)] END) AS frame_idx FROM nodes JOIN chosen USING (video_id, node)"

CURVE = f"{FRAMES}, {KEYS}, curve AS (SELECT video_id, frame_idx, round(least(greatest(max(list_inner_product(v, kv)), 0), 1), 9) AS x FROM frames JOIN keys USING (video_id) GROUP BY ALL)"
SEEN = "seen AS (SELECT user_id % 20 AS video_id, (row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id))::INT AS step, (event_id % 100)::INT AS t, (event_id % 10) / 10.0::DOUBLE AS relevance FROM events)"
BELIEF = CURVE + ", " + SEEN + """, b AS (SELECT 0 AS step, video_id, frame_idx, x AS mu, 1.0::DOUBLE AS sigma FROM curve UNION ALL
  SELECT s.step, b.video_id, frame_idx, least(greatest(CASE WHEN relevance > 0.6 THEN mu + relevance * exp(-pow(frame_idx - t, 2) / 4.5) ELSE mu * (1 - 0.5 * exp(-pow(frame_idx - t, 2) / 32)) END, 0), 1), sigma * (1 - exp(-pow(frame_idx - t, 2) / 32))
  FROM b JOIN seen s ON s.video_id = b.video_id AND s.step = b.step + 1),
b3 AS (SELECT video_id, frame_idx, arg_max(mu, step) AS mu, arg_max(sigma, step) AS sigma FROM b GROUP BY ALL)"""
#: The offline stand-in for a text encoder: tokens hashed into 64 signed counts, of unit length.
_PLACES = "list_transform(" + TOKENS + ", lambda t: {{'k': ('0x' || substr(md5(t), 1, 6))::INT % 64, 'x': CASE WHEN substr(md5(t), 7, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END}})"
def embedded(table: str, keys: str, text: str) -> str:
    """SQL of (keys, u): the vectors of a table's texts."""
    return f"(SELECT {keys}, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-8)) AS u FROM (SELECT {keys}, [coalesce(list_sum(list_transform(list_filter(h, lambda z: z.k = k), lambda z: z.x)), 0)::DOUBLE FOR k IN range(0, 64)] AS m FROM (SELECT {keys}, {_PLACES.format(text)} AS h FROM {table})))"
CAPTIONS = "told AS (SELECT user_id % 20 AS video_id, event_id, (event_id % 100)::DOUBLE AS st, (event_id % 100 + 5)::DOUBLE AS en, event_type FROM events), captions AS MATERIALIZED (SELECT video_id, node, string_agg(event_type, ' | ' ORDER BY event_id) AS caption FROM told JOIN nodes USING (video_id) WHERE st < e AND s < en GROUP BY ALL)"
ASKS = "asks AS (SELECT user_id % 20 AS video_id, (event_id % 10)::INT AS option, arg_min(event_type || ' ' || props, event_id) AS ask FROM events GROUP BY ALL)"
SEMANTIC = PRIOR + ", " + CAPTIONS + ", " + ASKS + ", cu AS MATERIALIZED " + embedded("captions", "video_id, node", "caption") + ", au AS MATERIALIZED " + embedded("asks", "video_id, option", "ask") + """,
sx AS (SELECT n.video_id, a.option, n.node, coalesce(list_inner_product(c.u, a.u), 0) AS x FROM nodes n JOIN au a ON a.video_id = n.video_id LEFT JOIN cu c ON c.video_id = n.video_id AND c.node = n.node),
semantic AS MATERIALIZED (SELECT video_id, option, node, CASE WHEN max(x) OVER w - min(x) OVER w < 1e-8 THEN least(greatest(x, 0), 1) ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END AS score FROM sx WINDOW w AS (PARTITION BY video_id, option)),
fused AS MATERIALIZED (SELECT video_id, option, node, 0.6 * coalesce(p.score, 0) + 0.4 * coalesce(s.score, 0) AS score FROM semantic s FULL JOIN (SELECT * FROM prior WHERE option IS NOT NULL) p USING (video_id, option, node))"""


def _curve(spark, d):
    f = S.frames(spark, d).join(S.keywords(spark, d), "video_id")
    return f.groupBy("video_id", "frame_idx").agg(F.round(V.clip01(F.max(V.dot(F.col("v"), F.col("kv")))), 9).alias("x"))


def _seen(spark, d):
    """A video's events as observations, in their order."""
    e = S.timeline(spark, d)
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("event_id"))
    return e.withColumn("step", rank).select("video_id", "step", (F.col("event_id") % 100).cast("int").alias("t"), ((F.col("event_id") % 10) / 10.0).alias("relevance"))


def _belief(spark, d):
    start = _curve(spark, d).select("video_id", "frame_idx", F.col("x").alias("mu"), F.lit(1.0).alias("sigma"))
    return C.update_belief(start, _seen(spark, d))


def captions_of(spark, d, n):
    """(video_id, node, caption): what events say of segments, in their order."""
    t = S.timeline(spark, d)
    m = G.events_in_segments(t, n).join(t.select("video_id", "event_id", "description"), ["video_id", "event_id"])
    told = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "description"))), lambda x: x["description"])
    return m.groupBy("video_id", "node").agg(F.array_join(told, " | ").alias("caption"))


def asks_of(spark, d):
    """(video_id, option, ask): a semantic query for each option."""
    e = S.read(spark, d, "events")
    return e.groupBy((F.col("user_id") % 20).alias("video_id"), (F.col("event_id") % 10).cast("int").alias("option")).agg(F.min_by(F.concat("event_type", F.lit(" "), "props"), "event_id").alias("ask"))


def _semantic(spark, d):
    n = nodes_of(spark, d)
    told = captions_of(spark, d, n).select("video_id", "node", T.embedding(T.tokens(F.col("caption"))).alias("c"))
    asks = asks_of(spark, d).select("video_id", "option", T.embedding(T.tokens(F.col("ask"))).alias("q"))
    return n, C.semantic_scores(n, told, asks)


CHANNELS = "p AS MATERIALIZED (SELECT video_id, option, node, round(score, 9) AS s FROM prior WHERE option IS NOT NULL), visited AS MATERIALIZED (SELECT video_id, node FROM chosen)"
FUSED = "p AS MATERIALIZED (SELECT video_id, option, node, round(score, 9) AS s FROM fused), visited AS MATERIALIZED (SELECT video_id, node FROM chosen)"
_MASKED = "m AS MATERIALIZED (SELECT p.video_id, p.option, p.node, CASE WHEN v.node IS NULL THEN s ELSE 0 END AS s FROM p LEFT JOIN visited v ON v.video_id = p.video_id AND v.node = p.node)"


def greedy(priority: str) -> str:
    """SQL of one node for each option: options by the priority table's best score take their best node that is left."""
    return _MASKED + f""", o AS (SELECT video_id, option, row_number() OVER (PARTITION BY video_id ORDER BY max(s) DESC, option) AS r FROM {priority} GROUP BY 1, 2),
ranked AS (SELECT video_id, option, list(node ORDER BY s DESC, node) AS nodes FROM m GROUP BY 1, 2),
taking AS (SELECT DISTINCT video_id, 0::BIGINT AS r, []::INT[] AS used FROM o UNION ALL
  SELECT t.video_id, o.r, list_append(used, coalesce(list_filter(k.nodes, lambda n: NOT list_contains(used, n))[1], k.nodes[1])) FROM taking t JOIN o ON o.video_id = t.video_id AND o.r = t.r + 1 JOIN ranked k ON k.video_id = o.video_id AND k.option = o.option),
anchors AS (SELECT o.video_id, o.option, t.used[o.r] AS node FROM o JOIN taking t ON t.video_id = o.video_id AND t.r = o.r)"""


def _visited(n, prior):
    """A search that has looked at the segments chosen first."""
    return G.first_choice(n, prior.where("option IS NULL")).select("video_id", "node")


def _channels(spark, d):
    n = nodes_of(spark, d)
    p = G.channel_prior(n, S.keywords(spark, d))
    return n, p, _visited(n, p)


@query(f"WITH RECURSIVE {CHOSEN}, {CHANNELS}, {greedy('p')} SELECT * FROM anchors")
def option_anchors(spark, d):
    _, p, v = _channels(spark, d)
    return C.option_anchors(p.where("option IS NOT NULL"), v)


@query(f"WITH RECURSIVE {CHOSEN}, {CHANNELS}, {_MASKED} SELECT video_id, option, node, row_number() OVER (PARTITION BY video_id, option ORDER BY s DESC, node)::INT AS rank FROM m WHERE s > 0")
def option_candidates(spark, d):
    _, p, v = _channels(spark, d)
    return C.candidates(p.where("option IS NOT NULL"), v)


@query(f"WITH RECURSIVE {CHOSEN}, visited AS MATERIALIZED (SELECT video_id, node FROM chosen), m AS (SELECT k.video_id, k.node, CASE WHEN v.node IS NULL THEN round(k.x, 9) ELSE 0 END AS s FROM (SELECT video_id, node, max(list_inner_product(v, kv)) AS x FROM nodes JOIN keys USING (video_id) GROUP BY ALL) k LEFT JOIN visited v USING (video_id, node)) SELECT video_id, arg_max(node, (s, -node)) AS node FROM m GROUP BY 1")
def search_by_keyword(spark, d):
    n, _, v = _channels(spark, d)
    return C.search(n, S.keywords(spark, d), v)


@query(f"WITH {CURVE}, a0 AS (SELECT DISTINCT video_id, []::INT[] AS used FROM curve)"
       + "".join(f", a{k} AS (SELECT video_id, list_append(used, arg_max(frame_idx, (x, -frame_idx))) AS used FROM a{k - 1} JOIN curve USING (video_id) WHERE len(list_filter(used, lambda u: abs(u - frame_idx) < 10)) = 0 GROUP BY video_id, used)" for k in range(1, 5))
       + " SELECT video_id, unnest(used) AS frame_idx FROM a4")
def find_peaks(spark, d):
    return C.find_peaks(_curve(spark, d), 4, 10)


@query(f"WITH RECURSIVE {BELIEF} SELECT video_id, frame_idx, round(mu, 6) + 0.0 AS mu, round(sigma, 6) + 0.0 AS sigma FROM b3")
def belief_update(spark, d):
    return _belief(spark, d).select("video_id", "frame_idx", r6("mu").alias("mu"), r6("sigma").alias("sigma"))


@query(f"WITH RECURSIVE {BELIEF} SELECT b.video_id, arg_max(frame_idx, (NOT EXISTS (SELECT 1 FROM seen s WHERE s.video_id = b.video_id AND relevance > 0.85 AND abs(s.t - b.frame_idx) <= 3), round(mu + sigma, 9), -frame_idx)) AS frame_idx FROM b3 b GROUP BY b.video_id")
def next_step(spark, d):
    return C.next_step(_belief(spark, d), _seen(spark, d).where("relevance > 0.85"))


@query(f"WITH RECURSIVE {FRAMES}, o AS (SELECT video_id, frame_idx, v, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS r FROM frames), walk AS (SELECT video_id, r, [v] AS kept, [frame_idx] AS ids FROM o WHERE r = 1 UNION ALL SELECT o.video_id, o.r, CASE WHEN ok THEN list_append(kept, v) ELSE kept END, CASE WHEN ok THEN list_append(ids, frame_idx) ELSE ids END FROM (SELECT o.*, kept, ids, len(list_filter(kept, lambda k: list_inner_product(k, o.v) > 0.3)) = 0 AS ok FROM walk w JOIN o ON o.video_id = w.video_id AND o.r = w.r + 1) o) SELECT video_id, unnest(arg_max(ids, r)) AS frame_idx FROM walk GROUP BY video_id")
def frame_dedup(spark, d):
    return C.drop_similar(S.frames(spark, d), 0.3)


@query(f"WITH {FRAMES}, m AS MATERIALIZED (SELECT a.video_id, a.frame_idx AS i, avg(list_inner_product(a.v, b.v)) AS mean FROM frames a JOIN frames b USING (video_id) GROUP BY ALL), a1 AS MATERIALIZED (SELECT video_id, arg_max(i, (round(mean, 9), -i)) AS i FROM m GROUP BY 1)"
       + "".join(f", t{k} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM a{n}" for n in range(1, k)) + f"), c{k} AS MATERIALIZED (SELECT m.video_id, m.i, m.mean - 0.3 * max(list_inner_product(x.v, y.v)) AS g FROM m JOIN frames x ON x.video_id = m.video_id AND x.frame_idx = m.i JOIN t{k} t ON t.video_id = m.video_id JOIN frames y ON y.video_id = t.video_id AND y.frame_idx = t.i GROUP BY m.video_id, m.i, m.mean HAVING count(*) FILTER (t.i = m.i) = 0), a{k} AS MATERIALIZED (SELECT video_id, arg_max(i, (round(g, 9), -i)) AS i FROM c{k} GROUP BY 1)" for k in range(2, 6))
       + " SELECT video_id, i AS frame_idx FROM (" + " UNION ALL ".join(f"SELECT * FROM a{n}" for n in range(1, 6)) + ")")
def diverse_anchors(spark, d):
    return C.diverse(S.frames(spark, d), 5)


@query(f"WITH RECURSIVE {SEMANTIC} SELECT video_id, option, node, round(score, 6) + 0.0 AS score FROM semantic")
def semantic_scores(spark, d):
    return _semantic(spark, d)[1].select("video_id", "option", "node", r6("score").alias("score"))


@query(f"WITH RECURSIVE {SEMANTIC} SELECT video_id, option, node, round(score, 6) + 0.0 AS score FROM fused")
def fused_scores(spark, d):
    n, s = _semantic(spark, d)
    return C.fuse(G.channel_prior(n, S.keywords(spark, d)).where("option IS NOT NULL"), s).select("video_id", "option", "node", r6("score").alias("score"))


def _fused(spark, d):
    n, s = _semantic(spark, d)
    p = G.channel_prior(n, S.keywords(spark, d))
    return C.fuse(p.where("option IS NOT NULL"), s), _visited(n, p)


_FUSED = CHOSEN + ", " + SEMANTIC.removeprefix(PRIOR + ", ") + ", " + FUSED


@query(f"WITH RECURSIVE {_FUSED}, {greedy('m')} SELECT * FROM anchors")
def fused_anchors(spark, d):
    """Options go by what is left of their scores here."""
    f, v = _fused(spark, d)
    return C.option_anchors(f, v, masked_first=True)


@query(f"WITH RECURSIVE {_FUSED}, {_MASKED} SELECT video_id, option, node, row_number() OVER (PARTITION BY video_id, option ORDER BY s DESC, node)::INT AS rank FROM m WHERE s > 0")
def fused_candidates(spark, d):
    return C.candidates(*_fused(spark, d))


@query(f"WITH RECURSIVE {SEMANTIC}, b AS (SELECT video_id, option, arg_max(node, (round(score, 9), -node)) AS node, max(score) AS top FROM semantic GROUP BY 1, 2) SELECT video_id, option, node FROM b WHERE round(top, 9) > 0")
def semantic_anchors(spark, d):
    """The best segment by what is said of it, for each query, where any says something of it."""
    s = _semantic(spark, d)[1].groupBy("video_id", "option").agg(F.max_by("node", F.struct(F.round("score", 9), -F.col("node"))).alias("node"), F.round(F.max("score"), 9).alias("top"))
    return s.where("top > 0").select("video_id", "option", "node")


@query("SELECT user_id % 20 AS video_id, event_id, (event_id % 100)::DOUBLE AS start_s, (event_id % 100 + 5)::DOUBLE AS end_s, event_type AS description FROM events")
def parse_timeline(spark, d):
    line = F.concat(F.lit("["), T.time_text(F.col("start")), F.lit(" – "), T.time_text(F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("end"))), F.lit("] "), "description")
    events = S.timeline(spark, d).select("video_id", "event_id", F.explode(T.timeline_events(line, F.lit(200.0))).alias("x"))
    return events.select("video_id", "event_id", F.col("x.start").alias("start_s"), F.col("x.end").alias("end_s"), "x.description")
