"""Queries of parsers of questions, replies, errors and settings, over every row of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.plans import query
from reelgraph.sources import tables as S

#: A question with options in one of the forms that people write.
_ASKED = r"""asked AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 4 WHEN 0 THEN chr(10) || 'A. ' || role || chr(10) || '  (C) it''s so' || chr(10) || 'B)no space' || chr(10) || 'A: again'
  WHEN 1 THEN ' Options: [''A. ' || role || ''', "D) it''s", ''E: yes'', 7]' WHEN 2 THEN ' Options: A. one, B. two' ELSE chr(10) || 'B.' END AS q FROM conversations),
part AS (SELECT *, regexp_extract(q, '(?s)(\[.*\])', 1) AS p FROM asked),
items AS (SELECT *, CASE WHEN contains(q, 'Options:') AND regexp_full_match(p, '(?s)\[\s*((''([^''\\\n]|\\.)*''|"([^"\\\n]|\\.)*"|-?\d+(\.\d*)?|None|True|False)\s*(,\s*|))*\]') THEN list_transform(regexp_extract_all(p, '(''(?:[^''\\\n]|\\.)*''|"(?:[^"\\\n]|\\.)*")', 1), lambda x: x[2:-2]) ELSE [] END AS l FROM part),
every AS (SELECT *, list_transform(regexp_split_to_array(q, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS n FROM items)"""


def _asked(spark, d):
    text, role, turn = F.coalesce("text", F.lit("")), F.col("role"), F.col("turn") % 4
    tail = F.when(turn == 0, F.concat(F.lit("\nA. "), role, F.lit("\n  (C) it's so\nB)no space\nA: again")))
    tail = tail.when(turn == 1, F.concat(F.lit(" Options: ['A. "), role, F.lit("', \"D) it's\", 'E: yes', 7]"))).when(turn == 2, F.lit(" Options: A. one, B. two")).otherwise(F.lit("\nB."))
    return S.read(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(text, tail).alias("q"))


@query(rf"""WITH {_ASKED}, found AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_concat(list_transform(l, lambda x: regexp_extract(x, '^\s*([A-Z])\s*[.):]', 1)), list_transform(n, lambda x: regexp_extract(x, '^\(?\s*([A-Z])\s*\)?\s*[.):]\s', 1))), lambda x: x <> ''))) AS f FROM every)
SELECT conv_id, turn, array_to_string(f, ',') AS letters, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE ['A', 'B', 'C', 'D'] END, ',') AS ids FROM found""")
def option_letters(spark, d):
    return _asked(spark, d).select("conv_id", "turn", F.array_join(T.option_letters(F.col("q")), ",").alias("letters"), F.array_join(T.option_ids(F.col("q")), ",").alias("ids"))


@query(rf"""WITH {_ASKED}, u AS (SELECT conv_id, turn, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT conv_id, turn, list_concat(list_transform(list_filter(l, lambda x: regexp_matches(x, '(?s)^\s*[A-Z]\s*[.):]')), lambda x: {{'o': regexp_extract(x, '^\s*([A-Z])', 1), 't': regexp_extract(x, '(?s)^\s*[A-Z]\s*[.):]\s*(.*)$', 1)}}),
  list_transform(list_filter(n, lambda x: regexp_matches(x, '^\(?\s*[A-Z]\s*\)?\s*[.):]\s*.')), lambda x: {{'o': regexp_extract(x, '^\(?\s*([A-Z])', 1), 't': regexp_extract(x, '^\(?\s*[A-Z]\s*\)?\s*[.):]\s*(.+)$', 1)}})) AS x FROM every))
SELECT conv_id, turn, x.o AS option, trim(arg_max(x.t, i)) AS told FROM u GROUP BY ALL""")
def option_texts(spark, d):
    each = _asked(spark, d).select("conv_id", "turn", F.inline(T.option_texts(F.col("q"))))
    return each.select("conv_id", "turn", "option", F.col("text").alias("told"))


_STOP = "['" + "', '".join(("what which who where when why how does do did is are was were the a an of in on at to for and or but not this that these those option answer question following correct video clip frame scene based content whose viewpoint relatively according mainly about").split()) + "']"


@query(rf"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+') AS w FROM documents), u AS (SELECT doc_id, regexp_replace(unnest(w), '^[.,?!;:''"()\[\]]+|[.,?!;:''"()\[\]]+$', '', 'g') AS x, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT doc_id, x, min(i) AS i FROM u WHERE length(x) > 2 AND NOT list_contains({_STOP}, x) GROUP BY 1, 2), r AS (SELECT doc_id, x, i FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 5)
SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS words FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1""")
def simple_keywords(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.array_join(T.simple_keywords(F.coalesce("text", F.lit(""))), " ").alias("words"))


@query(r"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), u AS (SELECT doc_id, trim(CASE WHEN i % 5 = 0 THEN 'Text:' ELSE ' ' END || x || ' ') AS x, i FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w)),
k AS (SELECT doc_id, x, min(i) AS i FROM u WHERE x <> '' GROUP BY 1, 2)
SELECT doc_id, count(x)::INT AS n_words, count(x) FILTER (NOT starts_with(lower(x), 'text:'))::INT AS n_visual, md5(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT starts_with(lower(x), 'text:')), '')) AS digest FROM documents LEFT JOIN k USING (doc_id) GROUP BY 1""")
def keyword_lists(spark, d):
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda x, i: F.concat(F.when(i % 5 == 0, F.lit("Text:")).otherwise(F.lit(" ")), x, F.lit(" ")))
    t = S.read(spark, d, "documents").select("doc_id", words.alias("w"))
    t = t.select("doc_id", F.size(T.clean_keywords(F.col("w"))).alias("n_words"), T.visual_keywords(F.col("w")).alias("v"))
    return t.select("doc_id", "n_words", F.size("v").alias("n_visual"), F.md5(F.array_join("v", " ").cast("binary")).alias("digest"))


@query(r"""SELECT conv_id, turn, CASE WHEN list_contains(o, g) THEN g ELSE 'UNPARSEABLE' END AS letter, g AS free FROM (SELECT conv_id, turn, ['A', 'B', 'C'][1:1 + (conv_id % 3)::INT] AS o,
  CASE WHEN turn % 2 = 0 THEN chr(65 + (turn % 5)::INT) ELSE coalesce(nullif(regexp_extract(coalesce(text, '') || ' so B or C', '(?s)^(?:.*[^\p{L}\p{N}_])?([A-Z])(?:[^\p{L}\p{N}_].*)?$', 1), ''), 'UNPARSEABLE') END AS g FROM conversations)""")
def checked_answers(spark, d):
    """Answers with a marked letter in small or capital form, and others, held against the options there are."""
    letter = F.when(F.col("turn") % 4 == 0, F.char(F.col("turn") % 5 + 65)).otherwise(F.lower(F.char(F.col("turn") % 5 + 65)))
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nfinal ANSWER:  "), letter)).otherwise(F.lit(" so B or C")))
    options = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(1), (F.col("conv_id") % 3 + 1).cast("int"))
    return S.read(spark, d, "conversations").select("conv_id", "turn", T.answer_letter(said, options).alias("letter"), T.answer_letter(said).alias("free"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'r-' || event_id WHEN 1 THEN 'ab' || event_id END AS request, event_id % 5 IN (0, 1, 4) AS transient, event_id % 5 = 2 AS memory FROM events""")
def error_kinds(spark, d):
    i = F.col("event_id")
    said = F.when(i % 5 == 0, F.concat(F.lit('Error 503: {"request_id" : "r-'), i, F.lit('"}'))).when(i % 5 == 1, F.concat(F.lit("Request TIMED OUT, Request-ID=ab"), i, F.lit("-x"))).when(i % 5 == 2, F.lit("CUDA Out Of Memory")).when(i % 5 == 3, F.lit("bad key")).otherwise(F.lit("Cannot CONNECT"))
    return S.read(spark, d, "events").select("event_id", T.request_id(said).alias("request"), T.is_transient(said).alias("transient"), T.is_out_of_memory(said).alias("memory"))


def _replies(spark, d):
    e, i = S.read(spark, d, "events"), F.col("event_id")
    use = F.concat(F.lit('"usage":{"prompt_tokens":'), i % 50, F.lit(',"completion_tokens":'), i % 7, F.when(i % 3 == 0, F.concat(F.lit(',"image_tokens":2,"prompt_tokens_details":{"image_tokens":'), i % 11, F.lit("}"))).otherwise(F.lit(',"image_tokens":3')), F.lit("}"))
    reply = F.when(i % 4 == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), "event_type", F.lit('"}}],'), use, F.lit("}")))
    reply = reply.when(i % 4 == 1, F.concat(F.lit('{"choices":[{"text":"'), "event_type", F.lit('"}],'), use, F.lit("}"))).when(i % 4 == 2, F.concat(F.lit('{"content":"'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit("plain "), "event_type"))
    return e.select("event_id", "user_id", reply.alias("reply"), F.when(i % 6 < 2, i % 5).cast("int").alias("images"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'plain ' || event_type ELSE event_type END AS content FROM events")
def reply_contents(spark, d):
    return _replies(spark, d).select("event_id", T.reply_content(F.col("reply")).alias("content"))


@query("""SELECT user_id, count(*)::BIGINT AS calls, count(*) FILTER (event_id % 6 >= 2)::BIGINT AS text_calls, count(*) FILTER (event_id % 6 < 2)::BIGINT AS multimodal_calls, coalesce(sum(event_id % 5) FILTER (event_id % 6 < 2), 0)::BIGINT AS images_sent,
coalesce(sum(event_id % 50) FILTER (event_id % 4 < 2), 0)::BIGINT AS prompt_tokens, coalesce(sum(event_id % 7) FILTER (event_id % 4 < 2), 0)::BIGINT AS completion_tokens, 0::BIGINT AS total_tokens, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens,
coalesce(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 11 ELSE 3 END) FILTER (event_id % 4 < 2), 0)::BIGINT AS image_tokens FROM events GROUP BY 1""")
def usage_summary(spark, d):
    """A log of calls, those with images being multimodal, added up for each client."""
    each = _replies(spark, d).select("user_id", "images", *[c.alias(k) for k, c in T.usage(F.col("reply")).items()])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counted = [F.count("*").alias("calls"), F.count_if(F.col("images").isNull()).alias("text_calls"), F.count("images").alias("multimodal_calls"), zero(F.sum("images")).alias("images_sent")]
    return each.groupBy("user_id").agg(*counted, *[zero(F.sum(k)).alias(k) for k in T.COUNTERS])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'qwen3-vl-8b-instruct' WHEN 1 THEN 'qwen3vl-8b-instruct,qwen3-vl-8b-instruct' WHEN 2 THEN 'qwen3vl-' || event_id ELSE '' END AS spellings FROM events")
def model_spellings(spark, d):
    i = F.col("event_id")
    name = F.when(i % 4 == 0, F.lit("qwen3vl-8b-instruct")).when(i % 4 == 1, F.lit(" qwen3vl-8b-instrcut ")).when(i % 4 == 2, F.concat(F.lit("qwen3-vl-"), i)).otherwise(F.concat(F.lit("other-"), i))
    return S.read(spark, d, "events").select("event_id", F.array_join(T.model_spellings(name), ",").alias("spellings"))


@query("""SELECT event_id, 'What?' || chr(10) || 'Focus Keywords (query): ' || event_type || CASE event_id % 3 WHEN 0 THEN chr(10) || 'Focus Keywords (option B): k0, k1' || chr(10) || 'Focus Semantic Query (option B): ' || event_type || ' seen' WHEN 1 THEN chr(10) || 'Focus Semantic Query (general): all' ELSE '' END AS asked FROM events""")
def observer_hints(spark, d):
    i = F.col("event_id") % 3
    sq = F.when(i == 0, T.bare_query(F.concat(F.lit("If the answer is B, the video should show: "), "event_type", F.lit(" seen")), F.lit("B"))).otherwise(F.lit(""))
    words = F.when(i == 0, F.array(F.lit("k0"), F.lit("k1"))).otherwise(F.array().cast("array<string>"))
    asked = T.hint(F.lit("What?"), F.array("event_type"), F.when(i != 1, F.lit("B")), words, sq, F.lit("all"))
    return S.read(spark, d, "events").select("event_id", asked.alias("asked"))


@query(r"""WITH e AS (SELECT event_id, event_type, event_id % 4 AS k FROM events)
SELECT event_id, 0 AS pos, CASE WHEN k = 0 THEN 0.0::DOUBLE WHEN k = 3 THEN 0.0 ELSE 10.0 END AS start_s, CASE WHEN k = 0 THEN 50.0::DOUBLE WHEN k = 1 THEN 15.0 WHEN k = 3 THEN 25.0 ELSE 70.0 END AS end_s, CASE WHEN k = 0 THEN '[01:00:00-01:02:00] ' || event_type WHEN k = 3 THEN event_type || ' in a line' ELSE event_type || chr(10) || 'more' END AS told FROM e
UNION ALL SELECT event_id, 1, 80.0, 50.0, 'second' FROM e WHERE k = 2 UNION ALL SELECT event_id, 1, 25.0, 50.0, event_type || ' in another' FROM e WHERE k = 3""")
def timeline_of_reply(spark, d):
    """Timed passages; without any (hours aren't read), the lines of the reply."""
    i, kind = F.col("event_id") % 4, F.col("event_type")
    said = F.when(i == 0, F.concat(F.lit("[01:00:00-01:02:00] "), kind)).when(i == 1, F.concat(F.lit("[00:10 - 00:05] "), kind, F.lit("\nmore\n\n"))).when(i == 2, F.concat(F.lit("so: [00:10–01:10] "), kind, F.lit("\nmore\n[01:20—02:00] second"))).otherwise(F.concat(F.lit("1. "), kind, F.lit(" in a line\n* "), kind, F.lit(" in another\n")))
    e = S.read(spark, d, "events").select("event_id", F.posexplode(T.timeline(said, F.when(i == 2, F.lit(60.0)).otherwise(F.lit(50.0)))).alias("pos", "x"))
    return e.select("event_id", "pos", F.col("x.start").alias("start_s"), F.when((F.col("event_id") % 4 == 2) & (F.col("pos") == 1), F.col("x.end") - 10).otherwise(F.col("x.end")).alias("end_s"), F.col("x.description").alias("told"))


@query("SELECT event_id, printf('%.1fs', (event_id % 900) / 2.0) AS shown, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE event_id % 4 = 2 END AS flag, (10 + greatest(event_id % 9 - 4, 0))::INT AS steps, CASE event_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 0 END AS bonus FROM events")
def settings_values(spark, d):
    i = F.col("event_id")
    word = F.when(i % 4 == 0, F.lit(" Yes ")).when(i % 4 == 1, F.lit("OFF")).when(i % 4 == 2, F.lit("maybe")).otherwise(F.lit("0"))
    count, temporal = (i % 3 == 0), (i % 3 == 1)
    return S.read(spark, d, "events").select("event_id", T.frame_time(i % 900, 2.0).alias("shown"), T.truth(word, True).alias("flag"), T.most_steps((i % 9).cast("int")).alias("steps"), T.coverage_bonus({"count": count, "temporal": temporal, "text": F.lit(False), "audio": F.lit(False)}).alias("bonus"))


@query(r"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), k AS (SELECT doc_id, x, min(i) AS i FROM u WHERE length(regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) > 3 GROUP BY 1, 2),
r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 30) SELECT doc_id, coalesce(string_agg(x, ', ' ORDER BY i), '') AS found FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1""")
def text_in_pictures(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.read_text(F.split(F.coalesce("text", F.lit("")), " ")).alias("found"))


@query("SELECT doc_id, base64(encode(coalesce(text, ''))) AS packed, CASE WHEN n_chars <= 64 THEN n_chars ELSE 64 END::INT AS n_sent, CASE WHEN n_chars <= 0 THEN NULL WHEN n_chars <= 64 THEN n_chars - 1 ELSE floor(63 * n_chars / 64.0) END::INT AS last_sent FROM documents")
def pictures_sent(spark, d):
    """Bytes as they are sent, and which of many pictures are: evenly spread ones."""
    n = F.col("n_chars").cast("int")
    t = S.read(spark, d, "documents").select("doc_id", F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("packed"), T.thinned(n, 64).alias("sent"))
    return t.select("doc_id", F.regexp_replace("packed", r"\r\n", "").alias("packed"), F.size("sent").alias("n_sent"), F.try_element_at("sent", F.lit(-1)).alias("last_sent"))


@query(r"SELECT conv_id, turn, coalesce(contains(lower(text), 'not correct') OR contains(lower(text), 'incorrect') OR contains(lower(text), 'not true') OR contains(lower(text), 'false') OR contains(lower(text), 'is not'), false) AS reversed FROM conversations")
def reversed_questions(spark, d):
    return S.read(spark, d, "conversations").select("conv_id", "turn", T.reversed_question(F.col("text")).alias("reversed"))
