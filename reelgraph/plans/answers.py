"""Queries of scores, evidence and the last choice of frames, with their SQL.

Visited segments are those that the greedy choice takes first, in its order. Captions are what events say of a
segment, text in pictures that of the document whose id is the video's times 100 plus the segment's.
"""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.functions import vectors as V
from reelgraph.operators import final as L
from reelgraph.operators import graph as G
from reelgraph.operators import scores as E
from reelgraph.operators import selection as C
from reelgraph.plans import HEARD, TOKENS, nodes_of, query, r6
from reelgraph.plans.selection import ASKS, CAPTIONS, CHOSEN, CURVE, _curve, _visited, asks_of, captions_of, embedded
from reelgraph.sources import tables as S
from reelgraph.workers import kept

_SEEDS = "('" + "', '".join("video clip scene frame screen visual show showing image picture footage camera shot view angle person people man woman guy girl someone background foreground left right center top bottom".split()) + "')"
NODES_HEARD = HEARD + ", heard AS MATERIALIZED (SELECT video_id, node, string_agg(said, ' ' ORDER BY k) AS text FROM (SELECT f.video_id, n.node, f.said, min(f.frame) AS k FROM by_frame f JOIN nodes n ON n.video_id = f.video_id AND f.frame BETWEEN n.s AND n.e GROUP BY ALL) GROUP BY 1, 2)"
VISITS = CHOSEN + ", " + CAPTIONS + ", " + ASKS + ", au AS MATERIALIZED " + embedded("asks", "video_id, option", "ask") + ", " + NODES_HEARD + f""",
visits AS MATERIALIZED (SELECT c.video_id, c.rank AS step, c.node, k.caption, h.text AS asr, d.text AS ocr FROM chosen c LEFT JOIN captions k USING (video_id, node) LEFT JOIN heard h USING (video_id, node) LEFT JOIN documents d ON d.doc_id = c.video_id * 100 + c.node),
toks AS MATERIALIZED (SELECT video_id, step, {TOKENS.format("(coalesce(caption, '') || CASE WHEN coalesce(ocr, '') <> '' THEN ' [OCR] ' || ocr ELSE '' END || CASE WHEN coalesce(asr, '') <> '' THEN ' [ASR] ' || asr ELSE '' END)")} AS t FROM visits),
words AS MATERIALIZED (SELECT video_id, step, tok, count(*) AS c FROM (SELECT video_id, step, unnest(t) AS tok FROM toks) GROUP BY ALL),
freq AS MATERIALIZED (SELECT video_id, step, tok, sum(c) OVER (PARTITION BY video_id, tok ORDER BY step) + CASE WHEN tok IN {_SEEDS} THEN 100 ELSE 0 END AS n FROM words),
total AS MATERIALIZED (SELECT video_id, step, sum(len(t)) OVER (PARTITION BY video_id ORDER BY step) + 2900 AS total FROM toks),
phrases AS MATERIALIZED (SELECT video_id, ask AS phrase FROM asks UNION SELECT user_id % 20, event_type FROM events),
texts AS MATERIALIZED (SELECT video_id, step, node, 'caption' AS source, caption AS text FROM visits UNION ALL SELECT video_id, step, node, 'ocr', ocr FROM visits UNION ALL SELECT video_id, step, node, 'asr', asr FROM visits)"""


def scored(texts: str, out: str) -> str:
    """SQL of the hybrid scores of a table of texts, as tables whose names end in out."""
    return f"""at{out} AS MATERIALIZED (SELECT s.video_id, s.step, w.tok, sum(w.c) AS n FROM (SELECT DISTINCT video_id, step FROM {texts}) s JOIN words w ON w.video_id = s.video_id AND w.step <= s.step GROUP BY ALL),
ot{out} AS (SELECT video_id, step, node, source, len(t) AS l, unnest(t) AS tok FROM (SELECT *, {TOKENS.format('text')} AS t FROM {texts})),
own{out} AS MATERIALIZED (SELECT video_id, step, node, source, tok, count(*) / any_value(l)::DOUBLE AS tf FROM ot{out} GROUP BY ALL),
pt{out} AS (SELECT video_id, phrase, tok, count(*) / any_value(l)::DOUBLE AS tf FROM (SELECT video_id, phrase, len(t) AS l, unnest(t) AS tok FROM (SELECT *, {TOKENS.format('phrase')} AS t FROM phrases)) GROUP BY ALL),
a{out} AS MATERIALIZED (SELECT o.*, tf * (ln((1 + total) / (1 + coalesce(n, 0) + CASE WHEN o.tok IN {_SEEDS} THEN 100 ELSE 0 END)) + 1) AS w FROM own{out} o JOIN total USING (video_id, step) LEFT JOIN at{out} x ON x.video_id = o.video_id AND x.step = o.step AND x.tok = o.tok),
b{out} AS MATERIALIZED (SELECT s.video_id, s.step, p.phrase, p.tok, tf * (ln((1 + total) / (1 + coalesce(n, 0) + CASE WHEN p.tok IN {_SEEDS} THEN 100 ELSE 0 END)) + 1) AS w FROM pt{out} p JOIN (SELECT DISTINCT video_id, step FROM {texts}) s ON s.video_id = p.video_id JOIN total t ON t.video_id = s.video_id AND t.step = s.step LEFT JOIN at{out} x ON x.video_id = s.video_id AND x.step = s.step AND x.tok = p.tok),
na{out} AS (SELECT video_id, step, node, source, sqrt(sum(w * w)) AS na FROM a{out} GROUP BY ALL), nb{out} AS (SELECT video_id, step, phrase, sqrt(sum(w * w)) AS nb FROM b{out} GROUP BY ALL),
d{out} AS (SELECT a.video_id, a.step, a.node, a.source, b.phrase, sum(a.w * b.w) AS d FROM a{out} a JOIN b{out} b ON b.video_id = a.video_id AND b.step = a.step AND b.tok = a.tok GROUP BY ALL),
sp{out} AS (SELECT video_id, step, node, source, max(d / (na * nb)) AS sparse FROM d{out} JOIN na{out} USING (video_id, step, node, source) JOIN nb{out} USING (video_id, step, phrase) GROUP BY ALL),
cut{out} AS (SELECT video_id, step, node, source, unnest([array_to_string(w[i * 50 + 1:i * 50 + 50], ' ') FOR i IN range(0, ceil(len(w) / 50.0)::INT)]) AS piece FROM (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {texts})),
de{out} AS (SELECT p.video_id, p.step, p.node, p.source, least(greatest(max(list_inner_product(p.u, q.u)), 0), 1) AS dense FROM {embedded(f'cut{out}', 'video_id, step, node, source', 'piece')} p JOIN au q ON q.video_id = p.video_id GROUP BY ALL),
sc{out} AS MATERIALIZED (SELECT video_id, step, node, source, text, CASE WHEN length(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) < 5 THEN 0 ELSE least(greatest(k * least(1, coalesce(sparse, 0) * 1.3::DOUBLE) + (1 - k) * coalesce(dense, 0), 0), 1) END AS score
  FROM (SELECT *, CASE source WHEN 'ocr' THEN 0.7::DOUBLE WHEN 'caption' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS k FROM {texts}) LEFT JOIN sp{out} USING (video_id, step, node, source) LEFT JOIN de{out} USING (video_id, step, node, source))"""


SCORED = VISITS + ", " + scored("texts", "1") + """,
topc AS MATERIALIZED (SELECT video_id, step, node, arg_max({'s': source, 'x': score, 't': text}, (score, -list_position(['asr', 'ocr', 'caption'], source))) AS b FROM sc1 GROUP BY ALL)"""
PLACED = "placed AS MATERIALIZED (SELECT f.video_id, f.pos, f.frame_idx, n.node, n.s, n.e FROM (SELECT video_id, frame_idx, (row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1)::INT AS pos FROM ({})) f JOIN nodes n ON n.video_id = f.video_id AND f.frame_idx BETWEEN n.s AND n.e)"
_PICKED = "SELECT DISTINCT video_id, unnest(CASE WHEN e - s + 1 <= 4 THEN range(s, e + 1)::INT[] ELSE [floor(s + i * (e - s + 1) / 4)::INT FOR i IN range(0, 4)] END) AS frame_idx FROM nodes JOIN chosen USING (video_id, node)"
_SHOWN = "printf('[%.1f-%.1fs] ', s::DOUBLE, e::DOUBLE) || upper({b}.s) || printf('(%.2f): ', {x}) || (SELECT CASE WHEN length(z) > 180 THEN z[1:180] || '...' ELSE z END FROM (SELECT trim(regexp_replace({b}.t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS z))"
_LINES = f"lines AS MATERIALIZED (SELECT video_id, pos, {_SHOWN.format(b='b', x='b.x')} AS line FROM topc JOIN (SELECT video_id, node, min(pos) AS pos, any_value(s) AS s, any_value(e) AS e FROM placed GROUP BY 1, 2) USING (video_id, node) WHERE b.x > 0 AND trim(b.t) <> '')"


class Search:
    """A video's visits and all that is known of them."""

    def __init__(self, spark, d):
        self.nodes = kept(nodes_of(spark, d))
        prior = G.channel_prior(self.nodes, S.keywords(spark, d))
        self.captions = kept(captions_of(spark, d, self.nodes))
        self.heard = kept(E.heard_in_nodes(E.heard_by_frame(S.transcript(spark, d)), self.nodes))
        chosen = G.first_choice(self.nodes, prior.where("option IS NULL")).select("video_id", F.col("rank").alias("step"), "node")
        ocr = S.read(spark, d, "documents").select((F.col("doc_id") / 100).cast("long").alias("video_id"), (F.col("doc_id") % 100).cast("int").alias("node"), F.col("text").alias("ocr"))
        key = ["video_id", "node"]
        self.visits = kept(chosen.join(self.captions, key, "left").join(self.heard.withColumnRenamed("text", "asr"), key, "left").join(ocr, key, "left"))
        self.freq, self.total = E.running_frequencies(self.visits.select("video_id", "step", E.combined(F.col("caption"), F.col("ocr"), F.col("asr")).alias("text")))
        asks = asks_of(spark, d)
        kinds = S.timeline(spark, d).select("video_id", F.col("description").alias("phrase")).distinct()
        self.phrases = asks.select("video_id", F.col("ask").alias("phrase")).unionByName(kinds).distinct()
        self.asks = asks.select("video_id", T.embedding(T.tokens(F.col("ask"))).alias("q"))
        each = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("text")) for c in E.CHANNELS])
        self.texts = self.visits.select("video_id", "step", "node", F.inline(each))

    @functools.cached_property
    def scored(self):
        return kept(self.score(self.texts))

    def score(self, texts):
        return E.channel_scores(texts, self.phrases, self.asks, self.freq, self.total)

    def rated(self):
        return self.visits.join(E.relevance(self.scored), ["video_id", "step"])

    def placed(self, frames):
        pos = (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1).alias("pos")
        return E.node_of(frames.select("video_id", "frame_idx", pos), self.nodes)

    def picked(self):
        return self.placed(G.frames_of(self.nodes, self.visits.select("video_id", "node")))


@query(f"WITH RECURSIVE {CHOSEN}, {NODES_HEARD} SELECT * FROM heard")
def heard_in_segments(spark, d):
    return E.heard_in_nodes(E.heard_by_frame(S.transcript(spark, d)), nodes_of(spark, d))


@query(f"WITH RECURSIVE {CHOSEN} SELECT f.video_id, f.frame_idx, n.node FROM frames f JOIN nodes n ON n.video_id = f.video_id AND f.frame_idx BETWEEN n.s AND n.e")
def segment_of_frame(spark, d):
    return E.node_of(S.frames(spark, d).select("video_id", "frame_idx"), nodes_of(spark, d)).select("video_id", "frame_idx", "node")


@query(f"WITH RECURSIVE {CHOSEN}, {CAPTIONS} SELECT video_id, node, arg_min(event_type, event_id) AS caption FROM told JOIN nodes USING (video_id) WHERE st < e AND s < en GROUP BY ALL")
def first_captions(spark, d):
    t = S.timeline(spark, d)
    m = G.events_in_segments(t, nodes_of(spark, d)).join(t.select("video_id", "event_id", "description"), ["video_id", "event_id"])
    return m.groupBy("video_id", "node").agg(F.min_by("description", "event_id").alias("caption"))


@query(f"WITH RECURSIVE {VISITS} SELECT video_id, step, tok, n::BIGINT AS n FROM freq")
def running_frequencies(spark, d):
    return Search(spark, d).freq.select("video_id", "step", "tok", F.col("n").cast("long").alias("n"))


@query(f"WITH RECURSIVE {SCORED} SELECT video_id, step, node, source, round(score, 6) + 0.0 AS score FROM sc1")
def channel_scores(spark, d):
    return Search(spark, d).scored.select("video_id", "step", "node", "source", r6("score").alias("score"))


@query(f"WITH RECURSIVE {SCORED} SELECT video_id, step, round(max(score), 6) + 0.0 AS by_text, round(greatest(max(score), (any_value(node) % 10) / 10.0), 6) + 0.0 AS with_model FROM sc1 GROUP BY 1, 2")
def step_relevance(spark, d):
    s = Search(spark, d)
    said = s.visits.select("video_id", "step", (F.col("node") % 10 / 10).alias("said"))
    both = E.relevance(s.scored).withColumnRenamed("relevance", "by_text").join(E.relevance(s.scored, said), ["video_id", "step"])
    return both.select("video_id", "step", r6("by_text").alias("by_text"), r6("relevance").alias("with_model"))


@query(f"WITH RECURSIVE {SCORED}, {PLACED.format(_PICKED)}, {_LINES} SELECT * FROM lines")
def evidence_lines(spark, d):
    s = Search(spark, d)
    return E.evidence_lines(s.rated(), s.scored, s.picked())


_SPREAD = "SELECT video_id, unnest(list_distinct([floor(i * (n - 1) / 31.0)::INT FOR i IN range(0, 32)])) AS frame_idx FROM (SELECT video_id, count(*) AS n FROM frames GROUP BY 1) WHERE n > 32 UNION ALL SELECT video_id, frame_idx FROM frames WHERE video_id IN (SELECT video_id FROM frames GROUP BY 1 HAVING count(*) <= 32)"


@query(f"""WITH RECURSIVE {SCORED}, {PLACED.format(_SPREAD)}, {_LINES}, late AS (SELECT video_id, max(step) AS step FROM visits GROUP BY 1),
rest AS MATERIALIZED (SELECT l.video_id, l.step, n.node, 'asr' AS source, h.text FROM nodes n JOIN late l USING (video_id) JOIN heard h USING (video_id, node) UNION ALL SELECT l.video_id, l.step, n.node, 'caption', k.caption FROM nodes n JOIN late l USING (video_id) JOIN captions k USING (video_id, node)),
{scored('rest', '2')}, others AS (SELECT video_id, node, arg_max({{'s': source, 'x': score, 't': text}}, (score, source = 'asr')) AS r FROM sc2 WHERE score > 0 GROUP BY 1, 2),
free AS (SELECT p.*, CASE WHEN b.b IS NOT NULL AND coalesce(b.b.t, '') <> '' THEN b.b ELSE o.r END AS b FROM placed p LEFT JOIN topc b ON b.video_id = p.video_id AND b.node = p.node LEFT JOIN others o ON o.video_id = p.video_id AND o.node = p.node WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.video_id = p.video_id AND l.pos = p.pos))
SELECT * FROM lines UNION ALL SELECT video_id, pos, {_SHOWN.format(b='b', x='CASE WHEN b.x <= 0 THEN 0.01 ELSE b.x END')} AS line FROM free WHERE trim(b.t) <> ''""")
def filled_lines(spark, d):
    """Evidence for evenly spread frames."""
    s = Search(spark, d)
    late = s.visits.groupBy("video_id").agg(F.max("step").alias("step"))
    rest = s.heard.select("video_id", "node", F.lit("asr").alias("source"), "text").unionByName(s.captions.select("video_id", "node", F.lit("caption").alias("source"), F.col("caption").alias("text")))
    others = s.score(rest.join(late, "video_id").select("video_id", "step", "node", "source", "text"))
    n = S.frames(spark, d).groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    placed = s.placed(n.select("video_id", F.explode(V.uniform_indices(F.col("n"), 32)).alias("frame_idx")))
    return E.filled_lines(E.evidence_lines(s.rated(), s.scored, placed), s.rated(), s.scored, others, placed)


@query(f"WITH RECURSIVE {VISITS}, {PLACED.format(_PICKED)} SELECT p.video_id, p.pos, printf('[%.1fs-%.1fs]: ', s::DOUBLE, e::DOUBLE) || caption AS line, min(step)::INT AS step FROM visits v JOIN placed p USING (video_id, node) WHERE coalesce(caption, '') <> '' GROUP BY ALL")
def caption_lines(spark, d):
    s = Search(spark, d)
    return E.caption_lines(s.visits, s.picked())


MIX = f"""size AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1), recalled AS MATERIALIZED (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS r FROM ({_PICKED})),
uniform AS MATERIALIZED (SELECT video_id, unnest(list_distinct([floor(i * (n - 1) / 11.0)::INT FOR i IN range(0, 12)])) AS frame_idx FROM size),
mix AS MATERIALIZED (SELECT video_id, frame_idx, true AS even FROM uniform UNION ALL SELECT r.video_id, r.frame_idx, false FROM recalled r WHERE r <= 20 AND NOT EXISTS (SELECT 1 FROM uniform u WHERE u.video_id = r.video_id AND u.frame_idx = r.frame_idx))"""


def _mix(spark, d):
    s = Search(spark, d)
    n = S.frames(spark, d).groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    even = n.select("video_id", F.explode(V.uniform_indices(F.col("n"), 12)).alias("frame_idx"), L.uniform_share(32, F.lit(8)).alias("share"))
    return L.mixed(even, G.frames_of(s.nodes, s.visits.select("video_id", "node")), 32)


@query(f"WITH RECURSIVE {CHOSEN}, {MIX} SELECT * FROM mix")
def uniform_and_recalled(spark, d):
    """A budget of 32 frames: 12 spread evenly (4 and 8 for a question of time), and the earliest 20 of those recalled."""
    return _mix(spark, d)


@query(f"""WITH RECURSIVE {CHOSEN}, {MIX}, curve AS MATERIALIZED (SELECT video_id, frame_idx, round(least(greatest(max(list_inner_product(v, kv)), 0), 1), 9) AS x FROM frames JOIN keys USING (video_id) GROUP BY ALL),
ev AS (SELECT video_id, list(frame_idx ORDER BY frame_idx) AS even, min(frame_idx) AS i0 FROM mix WHERE even GROUP BY 1),
one AS MATERIALIZED (SELECT e.video_id, list_concat(e.even, coalesce(list(m.frame_idx ORDER BY m.frame_idx) FILTER (NOT m.even AND list_inner_product(f.v, z.v) <= 0.1), [])) AS got FROM ev e JOIN mix m USING (video_id) JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx JOIN frames z ON z.video_id = e.video_id AND z.frame_idx = e.i0 GROUP BY e.video_id, e.even),
todo AS MATERIALIZED (SELECT m.video_id, m.frame_idx, row_number() OVER (PARTITION BY m.video_id ORDER BY m.frame_idx) AS r FROM mix m JOIN one USING (video_id) WHERE NOT list_contains(got, m.frame_idx)),
two AS (SELECT video_id, 0::BIGINT AS r, got FROM one UNION ALL SELECT t.video_id, t.r, CASE WHEN len(got) < 32 AND (SELECT max(list_inner_product(a.v, b.v)) FROM frames a, frames b WHERE a.video_id = w.video_id AND a.frame_idx = t.frame_idx AND b.video_id = w.video_id AND list_contains(w.got, b.frame_idx)) <= 0.3 THEN list_append(got, t.frame_idx) ELSE got END FROM two w JOIN todo t ON t.video_id = w.video_id AND t.r = w.r + 1),
held AS MATERIALIZED (SELECT video_id, arg_max(got, r) AS got FROM two GROUP BY 1),
far AS (SELECT f.video_id, f.frame_idx, least(greatest(min(list_inner_product(f.v, g.v)), 0), 1) AS sim FROM frames f JOIN held h USING (video_id) JOIN size USING (video_id) JOIN frames g ON g.video_id = f.video_id AND list_contains(h.got, g.frame_idx) WHERE NOT list_contains(h.got, f.frame_idx) AND f.frame_idx >= n * 0.05 AND f.frame_idx <= n * 0.95 GROUP BY ALL),
more AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY round(0.7 * (1 - sim) + 0.3 * x, 9) DESC, frame_idx) AS k FROM far JOIN curve USING (video_id, frame_idx) WHERE round(sim, 9) < 0.9),
whole AS (SELECT video_id, unnest(got) AS frame_idx FROM held UNION ALL SELECT video_id, frame_idx FROM more JOIN held USING (video_id) WHERE k + len(got) <= 32)
SELECT video_id, frame_idx FROM whole QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) <= 32""")
def final_frames(spark, d):
    """Thresholds are low, as the synthetic frames are unlike each other."""
    return L.final_frames(S.frames(spark, d), _mix(spark, d), _curve(spark, d), 32, 0.1, 0.3)


from reelgraph.plans.selection import CHANNELS, greedy  # noqa: E402

_SURE = f"""sure AS MATERIALIZED (SELECT video_id, 0 AS kind, option AS k, node FROM anchors UNION ALL SELECT video_id, 1, 0, node FROM (SELECT video_id, arg_max(node, (round(score, 9), -node)) AS node FROM prior WHERE option IS NULL GROUP BY 1) q WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.video_id = q.video_id AND a.node = q.node)),
have AS (SELECT video_id, count(*) AS have FROM sure GROUP BY 1), rest AS (SELECT c.video_id, 2 AS kind, c.rank AS k, c.node FROM chosen c JOIN have USING (video_id) WHERE c.rank <= 20 - have AND have < 16 AND NOT EXISTS (SELECT 1 FROM sure s WHERE s.video_id = c.video_id AND s.node = c.node)),
places AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY kind, k))::INT AS pos FROM (SELECT * FROM sure UNION ALL SELECT * FROM rest))"""


@query(f"WITH RECURSIVE {CHOSEN}, {CHANNELS.replace('FROM chosen)', 'FROM chosen WHERE false)')}, {greedy('p')}, {_SURE} SELECT video_id, pos, node FROM places WHERE kind < 2 OR pos <= 16")
def guaranteed_segments(spark, d):
    n = kept(nodes_of(spark, d))
    p = G.channel_prior(n, S.keywords(spark, d))
    ranked = G.first_choice(n, p.where("option IS NULL"))
    anchor = p.where("option IS NULL").groupBy("video_id").agg(F.max_by("node", F.struct(F.round("score", 9), -F.col("node"))).alias("node"))
    return L.guaranteed(C.option_anchors(p.where("option IS NOT NULL")), anchor, ranked, 64)


@query("SELECT doc_id, list_sort(list_distinct(list_concat([(doc_id % 30)::INT, (doc_id % 7)::INT], CASE WHEN n_chars <= 0 THEN []::INT[] WHEN n_chars <= 5 THEN range(0, n_chars)::INT[] ELSE [floor(i * (n_chars - 1) / 4)::INT FOR i IN range(0, 5)] END))) AS merged FROM documents")
def merged_with_uniform(spark, d):
    i = F.col("doc_id").cast("int")
    got = L.merged(F.array(i % 30, i % 7), V.uniform_indices(F.col("n_chars"), 5), 32)
    return S.read(spark, d, "documents").select("doc_id", got.alias("merged"))
