"""Registered queries of the engine's own operators, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.functions import vectors as V
from reelgraph.operators import graph as G
from reelgraph.operators import scores
from reelgraph.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FRAMES = "frames AS (SELECT vec_id // 100 AS video_id, (vec_id % 100)::INT AS frame_idx, label, embedding::DOUBLE[] AS v FROM embeddings)"
CUT = FRAMES + """, sims AS (SELECT *, list_inner_product(lag(v) OVER w, v) AS sim FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
cuts AS (SELECT *, (sum(CASE WHEN sim < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx))::INT AS node FROM sims)"""
_DOT = "((list_inner_product(p[{b} + 1], p[{d} + 1]) - list_inner_product(p[{b} + 1], p[{c} + 1]) - list_inner_product(p[{a} + 1], p[{d} + 1]) + list_inner_product(p[{a} + 1], p[{c} + 1])) / (({b} - {a}) * ({d} - {c})))"
SEGS = CUT + f""", dims AS (SELECT video_id, frame_idx, unnest(range(1, 65)) AS k, unnest(v) AS x FROM frames),
running AS (SELECT video_id, frame_idx, k, sum(x) OVER (PARTITION BY video_id, k ORDER BY frame_idx) AS x FROM dims),
upto AS (SELECT video_id, frame_idx, list(x ORDER BY k) AS p FROM running GROUP BY ALL),
sums AS MATERIALIZED (SELECT video_id, list_prepend([0.0::DOUBLE FOR i IN range(0, 64)], list(p ORDER BY frame_idx)) AS p FROM upto GROUP BY 1),
b0 AS (SELECT video_id, list_append(list(s ORDER BY s), max(e) + 1) AS b FROM (SELECT video_id, node, min(frame_idx) AS s, max(frame_idx) AS e FROM cuts GROUP BY ALL) GROUP BY 1),
walk AS (SELECT video_id, b, [b[1]] AS kept, 2 AS k, false AS done FROM b0
  UNION ALL SELECT video_id, CASE WHEN k > len(b) THEN kept ELSE b END,
    CASE WHEN k > len(b) THEN [kept[1]] WHEN here - lo >= 10 THEN list_append(kept, here) WHEN l > 0 AND l >= r THEN list_append(kept[1:len(kept) - 1], here) WHEN r > 0 THEN kept ELSE list_append(kept, here) END,
    CASE WHEN k > len(b) THEN 2 ELSE k + 1 END, k > len(b) AND len(kept) = len(b)
  FROM (SELECT *, b[k] AS here, kept[len(kept)] AS lo,
    CASE WHEN len(kept) > 1 AND k <= len(b) THEN {_DOT.format(a="kept[len(kept) - 1]", b="kept[len(kept)]", c="kept[len(kept)]", d="b[k]")} ELSE -1 END AS l,
    CASE WHEN k < len(b) THEN {_DOT.format(a="kept[len(kept)]", b="b[k]", c="b[k]", d="b[k + 1]")} ELSE -1 END AS r FROM walk JOIN sums USING (video_id) WHERE NOT done)),
segs AS MATERIALIZED (SELECT video_id, (i - 1)::INT AS node, b[i]::INT AS s, (b[i + 1] - 1)::INT AS e FROM (SELECT video_id, b, unnest(range(1, len(b))) AS i FROM walk WHERE done))"""
POOL = SEGS + """, means AS (SELECT video_id, node, s, e, [(p[e + 2][k] - p[s + 1][k]) / (e - s + 1) FOR k IN range(1, 65)] AS m FROM segs JOIN sums USING (video_id)),
nodes AS MATERIALIZED (SELECT video_id, node, s, e, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-8)) AS v FROM means)"""
EDGES = POOL + """, every AS (SELECT a.video_id, a.node AS i, b.node AS j, round(0.6 * least(greatest(list_inner_product(a.v, b.v), 0), 1) + 0.4 * exp(-abs((a.s + a.e) / 2 - (b.s + b.e) / 2) / 30), 9) AS w
  FROM nodes a JOIN nodes b ON a.video_id = b.video_id AND a.node <> b.node),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY video_id, i ORDER BY w DESC, j) <= 8),
both_ AS (SELECT video_id, i, j, sum(w / 2) AS w FROM (SELECT video_id, i, j, w FROM best UNION ALL SELECT video_id, j, i, w FROM best) GROUP BY ALL),
deg AS (SELECT video_id, i, sum(w) AS d FROM both_ GROUP BY ALL),
edges AS MATERIALIZED (SELECT b.video_id, b.i, b.j, b.w, b.w / sqrt(x.d * y.d) AS w_norm FROM both_ b JOIN deg x ON x.video_id = b.video_id AND x.i = b.i JOIN deg y ON y.video_id = b.video_id AND y.i = b.j)"""
KEYS = "keys AS (SELECT video_id, label AS option, kv FROM (SELECT DISTINCT video_id, label FROM frames) JOIN (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS kv FROM embeddings GROUP BY 1) USING (label))"
PRIOR = EDGES + ", " + KEYS + """, prior AS MATERIALIZED (SELECT video_id, node, option, least(greatest(max(list_inner_product(v, kv)), 0), 1) AS score FROM nodes JOIN keys USING (video_id) GROUP BY GROUPING SETS ((video_id, node, option), (video_id, node)))"""
STEPS = PRIOR + ", f0 AS (SELECT video_id, node, score AS y, score AS f FROM prior WHERE option IS NULL)" + "".join(
    f", f{n} AS (SELECT a.video_id, a.node, a.y, 0.6 * coalesce(sum(e.w_norm * b.f), 0) + 0.4 * a.y AS f FROM f{n - 1} a LEFT JOIN edges e ON e.video_id = a.video_id AND e.i = a.node LEFT JOIN f{n - 1} b ON b.video_id = e.video_id AND b.node = e.j GROUP BY a.video_id, a.node, a.y)"
    for n in range(1, 8)
)
TOKENS = "list_filter(string_split(trim(regexp_replace(replace(lower({}), 'text:', ' '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    """Merged segments: the synthetic frames are unlike each other, so the threshold is 0."""
    return G.segments(S.frames(spark, d), 0.0, 10)


@query(f"WITH {FRAMES} SELECT video_id, frame_idx, frame_idx / 2.0 AS ts FROM frames WHERE frame_idx % 2 = 0")
def frame_sample(spark, d):
    f = S.frames(spark, d).where("frame_idx % 2 = 0")
    return f.select("video_id", "frame_idx", (F.col("frame_idx") / 2.0).alias("ts"))


@query(f"WITH {FRAMES} SELECT video_id, frame_idx FROM frames WHERE frame_idx >= 18 AND frame_idx < 22")
def clip_range_scan(spark, d):
    return S.frames(spark, d).where("frame_idx >= 18 AND frame_idx < 22").select("video_id", "frame_idx")


@query(f"WITH {CUT} SELECT video_id, frame_idx, round(sim, 6) + 0.0 AS sim FROM cuts WHERE sim IS NOT NULL")
def adjacent_similarity(spark, d):
    return G.adjacent_similarity(S.frames(spark, d)).select("video_id", "frame_idx", r6("sim").alias("sim"))


@query(f"WITH {CUT} SELECT video_id, node, min(frame_idx) AS s, max(frame_idx) AS e FROM cuts GROUP BY ALL")
def segment_cut(spark, d):
    return G.cut(S.frames(spark, d), 0.0).groupBy("video_id", "node").agg(F.min("frame_idx").alias("s"), F.max("frame_idx").alias("e"))


@query(f"WITH RECURSIVE {SEGS} SELECT * FROM segs")
def segment_merge(spark, d):
    return nodes_of(spark, d).select("video_id", "node", "s", "e")


@query(f"WITH RECURSIVE {POOL} SELECT video_id, node, s, e, round(v[1], 6) + 0.0 AS v1, round(v[64], 6) + 0.0 AS v64 FROM nodes")
def segment_pool(spark, d):
    return nodes_of(spark, d).select("video_id", "node", "s", "e", r6(F.col("v")[0]).alias("v1"), r6(F.col("v")[63]).alias("v64"))


@query(f"WITH RECURSIVE {POOL} SELECT a.video_id, a.node AS i, b.node AS j, round(list_inner_product(a.v, b.v), 6) + 0.0 AS sim FROM nodes a JOIN nodes b ON a.video_id = b.video_id AND a.node < b.node")
def pairwise_cosine(spark, d):
    n = nodes_of(spark, d)
    a, b = n.select("video_id", F.col("node").alias("i"), F.col("v").alias("a")), n.select("video_id", F.col("node").alias("j"), F.col("v").alias("b"))
    return a.join(b, "video_id").where("i < j").select("video_id", "i", "j", r6(V.dot(F.col("a"), F.col("b"))).alias("sim"))


@query(f"WITH RECURSIVE {EDGES} SELECT video_id, i, j, round(w, 6) AS w, round(w_norm, 6) AS w_norm FROM edges")
def affinity_normalized(spark, d):
    return G.affinity(nodes_of(spark, d)).select("video_id", "i", "j", r6("w").alias("w"), r6("w_norm").alias("w_norm"))


@query(f"WITH RECURSIVE {PRIOR} SELECT video_id, node, option, round(score, 6) + 0.0 AS score FROM prior")
def channel_prior(spark, d):
    return G.channel_prior(nodes_of(spark, d), S.keywords(spark, d)).select("video_id", "node", "option", r6("score").alias("score"))


def _belief(spark, d):
    n = nodes_of(spark, d)
    e = G.affinity(n)
    return n, e, G.propagate(e, G.channel_prior(n, S.keywords(spark, d)).where("option IS NULL"))


@query(f"WITH RECURSIVE {STEPS} SELECT video_id, node, round(y, 5) + 0.0 AS y, round(f, 5) + 0.0 AS f FROM f7")
def propagate(spark, d):
    return _belief(spark, d)[2].select("video_id", "node", (F.round("y", 5) + 0.0).alias("y"), (F.round("f", 5) + 0.0).alias("f"))


@query()
def nms(spark, d):
    _, e, f = _belief(spark, d)
    return G.nms(e, f)


@query()
def evidence_frames(spark, d):
    return G.evidence_frames(S.frames(spark, d), S.keywords(spark, d), 0.0, 10)


@query(f"WITH {FRAMES}, {KEYS} SELECT video_id, frame_idx, round(least(greatest(max(list_inner_product(v, kv)), 0), 1), 6) AS score FROM frames JOIN keys USING (video_id) GROUP BY ALL")
def frame_scores(spark, d):
    f = S.frames(spark, d).join(S.keywords(spark, d), "video_id")
    return f.groupBy("video_id", "frame_idx").agg(r6(V.clip01(F.max(V.dot(F.col("v"), F.col("kv"))))).alias("score"))


@query(f"WITH {FRAMES}, {KEYS}, s AS (SELECT video_id, frame_idx, max(list_inner_product(v, kv)) AS x FROM frames JOIN keys USING (video_id) GROUP BY ALL), m AS (SELECT *, max(x) OVER (PARTITION BY video_id) AS hi, min(x) OVER (PARTITION BY video_id) AS lo FROM s) SELECT video_id, frame_idx, round((x - lo) / (hi - lo), 6) AS scaled, round(exp((x - hi) / 0.1) / sum(exp((x - hi) / 0.1)) OVER (PARTITION BY video_id), 6) AS mu FROM m")
def belief_prior(spark, d):
    f = S.frames(spark, d).join(S.keywords(spark, d), "video_id")
    s = f.groupBy("video_id", "frame_idx").agg(F.max(V.dot(F.col("v"), F.col("kv"))).alias("x"))
    w = Window.partitionBy("video_id")
    return s.select("video_id", "frame_idx", r6(V.min_max(F.col("x"), w)).alias("scaled"), r6(V.softmax(F.col("x"), w)).alias("mu"))


@query("SELECT doc_id, CASE WHEN n_chars <= 0 THEN [] WHEN n_chars <= 7 THEN range(0, n_chars)::INT[] ELSE list_sort(list_distinct([floor(i * (n_chars - 1) / 6)::INT FOR i IN range(0, 7)])) END AS idx FROM documents")
def uniform_sample(spark, d):
    return S.read(spark, d, "documents").select("doc_id", V.uniform_indices(F.col("n_chars"), 7).alias("idx"))


@query("SELECT event_id, round(exp(-pow((event_id % 40) - 20, 2) / 18.0), 6) AS g, round(exp(-0.001 * pow((event_id % 40) - (event_id % 7), 2)), 6) AS decay FROM events")
def kernels(spark, d):
    t, o = F.col("event_id") % 40, F.col("event_id") % 7
    return S.read(spark, d, "events").select("event_id", r6(V.gaussian(t, F.lit(20), 3.0)).alias("g"), r6(V.temporal_decay(t, o)).alias("decay"))


@query(r"""SELECT conv_id, turn, coalesce(regexp_matches(lower(text), '\b(not correct|incorrect|not true|false|is not)\b'), false) AS not_correct,
coalesce(regexp_matches(lower(text), '\b(first|last|before|after|then|earlier|later|beginning|end|start|finally|next|previous)\b'), false) AS temporal,
coalesce(regexp_matches(lower(text), '\b(how many|number of|count|times)\b'), false) AS count,
coalesce(regexp_matches(lower(text), '\b(text|title|word|name|label|subtitle|sign|caption|written|letter|logo|year|date)\b'), false) AS text,
coalesce(regexp_matches(lower(text), '\b(hear|said|says|narrator|voice|sound|music|audio|spoken|speak)\b'), false) AS audio FROM conversations""")
def question_flags(spark, d):
    return S.read(spark, d, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in T.question_flags(F.col("text")).items()])


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens, md5(array_to_string({TOKENS.format('text')}, ' ')) AS digest FROM documents")
def tokenise(spark, d):
    t = S.read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"SELECT tok, count(*)::BIGINT AS n FROM (SELECT unnest({TOKENS.format('text')}) AS tok FROM documents) GROUP BY 1")
def token_frequencies(spark, d):
    return S.read(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents), e AS (SELECT id, len(t) AS l, tok, count(*) AS c FROM (SELECT id, t, unnest(t) AS tok FROM t) GROUP BY ALL),
fr AS (SELECT tok, sum(c) AS n FROM e GROUP BY 1), tt AS (SELECT sum(n) AS total FROM fr),
p AS (SELECT item_id AS phrase, {TOKENS.format("text")} AS t FROM benchmark), pe AS (SELECT phrase, len(t) AS l, tok, count(*) AS c FROM (SELECT phrase, t, unnest(t) AS tok FROM p) GROUP BY ALL),
a AS (SELECT id, e.tok, c / l * (ln((1 + total) / (1 + n)) + 1) AS w FROM e JOIN fr USING (tok), tt), b AS (SELECT phrase, pe.tok, c / l * (ln((1 + total) / (1 + coalesce(n, 0))) + 1) AS w FROM pe LEFT JOIN fr USING (tok), tt),
na AS (SELECT id, sqrt(sum(w * w)) AS na FROM a GROUP BY 1), nb AS (SELECT phrase, sqrt(sum(w * w)) AS nb FROM b GROUP BY 1),
d AS (SELECT id, phrase, sum(a.w * b.w) AS d FROM a JOIN b ON a.tok = b.tok GROUP BY ALL) SELECT id, max(round(d / (na * nb), 5)) AS score FROM d JOIN na USING (id) JOIN nb USING (phrase) GROUP BY 1""")
def tfidf(spark, d):
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return G.tfidf(docs, S.read(spark, d, "benchmark").select(F.col("item_id").alias("phrase"), T.tokens(F.col("text")).alias("tokens"))).groupBy("id").agg(F.max(F.round("score", 5)).alias("score"))


@query("SELECT event_id, lpad(((event_id * 7) // 60)::VARCHAR, greatest(2, length(((event_id * 7) // 60)::VARCHAR))::INT, '0') || ':' || lpad(((event_id * 7) % 60)::VARCHAR, 2, '0') AS shown, (event_id * 7)::DOUBLE AS seconds FROM events")
def time_texts(spark, d):
    shown = T.time_text(F.col("event_id") * 7)
    return S.read(spark, d, "events").select("event_id", shown.alias("shown"), T.time_value(shown).alias("seconds"))


_ALONE = r"regexp_extract({}, '(?s)^(?:.*[^\p{{L}}\p{{N}}_])?([A-Z])(?:[^\p{{L}}\p{{N}}_].*)?$', 1)"


@query(rf"SELECT doc_id, coalesce(nullif({_ALONE.format('text')}, ''), 'UNPARSEABLE') AS letter FROM documents")
def answer_letters(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.answer_letter(F.col("text")).alias("letter"))


@query(r"SELECT doc_id, len(w)::INT AS n_words, ceil(len(w) / 50.0)::INT AS n_pieces, md5(coalesce(array_to_string([array_to_string(w[i * 50 + 1:i * 50 + 50], ' ') FOR i IN range(0, ceil(len(w) / 50.0)::INT)], chr(10)), '')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents)")
def text_pieces(spark, d):
    docs = S.read(spark, d, "documents").select("doc_id", T.pieces(F.col("text")).alias("p"))
    words = F.aggregate("p", F.lit(0), lambda a, x: a + F.size(F.split(x, " ")))
    return docs.select("doc_id", words.alias("n_words"), F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\n").cast("binary")).alias("digest"))


@query(f"WITH RECURSIVE {POOL}, t AS (SELECT user_id % 20 AS video_id, event_id, (event_id % 100)::DOUBLE AS st, (event_id % 100 + 5)::DOUBLE AS en FROM events) SELECT video_id, event_id, node FROM t JOIN nodes USING (video_id) WHERE st < e AND s < en")
def events_to_segments(spark, d):
    return G.events_in_segments(S.timeline(spark, d), nodes_of(spark, d))


@query(f"WITH RECURSIVE {POOL}, t AS (SELECT user_id % 20 AS video_id, event_id, (event_id % 100)::DOUBLE AS st, (event_id % 100 + 5)::DOUBLE AS en, event_type FROM events) SELECT video_id, node, string_agg(event_type, ' | ' ORDER BY event_id) AS caption FROM t JOIN nodes USING (video_id) WHERE st < e AND s < en GROUP BY ALL")
def segment_captions(spark, d):
    t = S.timeline(spark, d)
    m = G.events_in_segments(t, nodes_of(spark, d)).join(t.select("video_id", "event_id", "description"), ["video_id", "event_id"])
    told = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "description"))), lambda x: x["description"])
    return m.groupBy("video_id", "node").agg(F.array_join(told, " | ").alias("caption"))


HEARD = """spoken AS (SELECT conv_id AS video_id, turn * 15 AS st, unnest(range(turn * 15, turn * 15 + 21)) AS frame, text FROM conversations WHERE text <> ''),
by_frame AS MATERIALIZED (SELECT video_id, frame, list_reduce(list(text ORDER BY st, text), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ' ' || x END) AS said FROM spoken GROUP BY ALL)"""


@query(f"WITH {HEARD} SELECT * FROM by_frame")
def transcript_by_frame(spark, d):
    return scores.heard_by_frame(S.transcript(spark, d))


@query("WITH a AS (SELECT user_id, max(r) AS mx, avg(r) AS mean, avg((r < 0.2)::INT) AS low FROM (SELECT user_id, (event_id % 97) / 97.0 * (user_id % 11) / 10.0 AS r FROM events UNION ALL SELECT c_custkey, NULL FROM customer) GROUP BY 1), b AS (SELECT user_id, CASE WHEN mx IS NULL THEN 'none' WHEN mx < 0.4 THEN 'max' WHEN mean < 0.2 THEN 'mean' WHEN mx - mean < 0.15 THEN 'flat' WHEN low > 0.7 THEN 'low' END AS reason FROM a) SELECT user_id, reason IS NOT NULL AS fallback, coalesce(reason, '') AS reason FROM b")
def fallback_rule(spark, d):
    r = (F.col("event_id") % 97) / 97.0 * (F.col("user_id") % 11) / 10.0
    seen = S.read(spark, d, "events").select("user_id", r.alias("r"))
    # A video nobody has looked at has a row without a relevance.
    return G.fallback(seen.unionByName(S.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(None).cast("double").alias("r"))), "user_id")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def parse_json(spark, d):
    return S.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT quality, avg(CASE WHEN upper(substr(trim(text), 1, 1)) = upper(substr(trim(source), 1, 1)) THEN 1 ELSE 0 END)::DECIMAL(18,6)::DOUBLE AS accuracy, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def letter_accuracy(spark, d):
    first = lambda c: F.upper(F.substring(F.trim(c), 1, 1))
    t = S.read(spark, d, "labels").join(S.read(spark, d, "documents").select("doc_id", (first("text") == first("source")).alias("right")), "doc_id")
    return t.groupBy("quality").agg(r6(F.avg(F.coalesce("right", F.lit(False)).cast("int"))).alias("accuracy"), F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from reelgraph.plans import answers, evidence, scans, selection, texts  # noqa: E402, F401
