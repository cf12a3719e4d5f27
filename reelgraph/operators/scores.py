"""How well texts answer a question: sparse and dense scores, running word frequencies, evidence for frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.functions.vectors import clip01, dot

#: Share of the sparse score in that of a channel; the dense one has the rest.
SPARSE = {"ocr": 0.7, "asr": 0.5, "caption": 0.3}
#: Order in which channels of the same score give evidence, and letters of it that are shown.
CHANNELS, SHOWN = ("asr", "ocr", "caption"), 180


def combined(caption: Column, ocr: Column, asr: Column) -> Column:
    """All that is known of a segment as one text, with its parts marked."""
    part = lambda mark, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f" [{mark}] "), x)).otherwise(F.lit(""))
    return F.concat(F.coalesce(caption, F.lit("")), part("OCR", ocr), part("ASR", asr))


def running_frequencies(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((video_id, step, tok, n), (video_id, step, total)) after each step.

    seen: (video_id, step, text), step from 1 on. A step's own words count in it. Words that descriptions of pictures
    often have start at a high count. The first table has rows only where a word's count changes.
    """
    words = seen.select("video_id", "step", F.explode(T.tokens(F.col("text"))).alias("tok")).groupBy("video_id", "step", "tok").agg(F.count("*").alias("c"))
    w = Window.partitionBy("video_id", "tok").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    seed = F.when(F.col("tok").isin(*T.SEEN_OFTEN), T.SEED).otherwise(0)
    freq = words.select("video_id", "step", "tok", (F.sum("c").over(w) + seed).alias("n"))
    v = Window.partitionBy("video_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    each = seen.select("video_id", "step", F.size(T.tokens(F.col("text"))).alias("c"))
    return freq, each.select("video_id", "step", (F.sum("c").over(v) + T.SEED * len(T.SEEN_OFTEN)).alias("total"))


def sparse_scores(texts: DataFrame, phrases: DataFrame, freq: DataFrame, total: DataFrame) -> DataFrame:
    """(video_id, step, node, source, sparse): the best cosine of tf-idf vectors of a text and any of its video's phrases.

    texts: (video_id, step, node, source, text); phrases: (video_id, phrase). idf = ln((1 + total) / (1 + n)) + 1, with the
    counts that hold at the text's step.
    """
    key = ["video_id", "step", "node", "source"]
    t = texts.select(*key, T.tokens(F.col("text")).alias("t"))
    own = t.select(*key, F.size("t").alias("len"), F.explode("t").alias("tok")).groupBy(*key, "len", "tok").agg((F.count("*") / F.col("len")).alias("tf"))
    p = phrases.select("video_id", "phrase", T.tokens(F.col("phrase")).alias("t")).distinct()
    p = p.select("video_id", "phrase", F.size("t").alias("len"), F.explode("t").alias("tok")).groupBy("video_id", "phrase", "len", "tok").agg((F.count("*") / F.col("len")).alias("tf"))
    # The count of a word at a step is that of its last change: changes are intervals of steps.
    after = F.lead("step").over(Window.partitionBy("video_id", "tok").orderBy("step"))
    spans = freq.select("video_id", "tok", "n", F.col("step").alias("since"), after.alias("until"))
    steps = texts.select("video_id", "step").distinct()
    at = steps.join(spans, "video_id").where("step >= since AND (until IS NULL OR step < until)").select("video_id", "step", "tok", "n")
    idf = F.log((1.0 + F.col("total")) / (1.0 + F.coalesce("n", F.when(F.col("tok").isin(*T.SEEN_OFTEN), T.SEED).otherwise(0)))) + 1.0
    weigh = lambda x: x.join(at, ["video_id", "step", "tok"], "left").join(total, ["video_id", "step"]).withColumn("w", F.col("tf") * idf)
    a = weigh(own).select(*key, "tok", "w")
    b = weigh(p.join(steps, "video_id")).select("video_id", "step", "phrase", "tok", F.col("w").alias("x"))
    size = lambda df, by, c: df.groupBy(*by).agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"n{c}"))
    both = a.join(b, ["video_id", "step", "tok"]).groupBy(*key, "phrase").agg(F.sum(F.col("w") * F.col("x")).alias("d"))
    both = both.join(size(a, key, "w"), key).join(size(b, ["video_id", "step", "phrase"], "x"), ["video_id", "step", "phrase"])
    return both.groupBy(*key).agg(F.max(F.col("d") / (F.col("nw") * F.col("nx"))).alias("sparse"))


def dense_scores(texts: DataFrame, asks: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(video_id, step, node, source, dense): the best product of the vectors of a text's pieces and its video's queries
    (video_id, q), in [0, 1]. vectors: adds u to rows with the column piece; the stand-in's if not given."""
    key = ["video_id", "step", "node", "source"]
    pieces = texts.select(*key, F.explode(T.pieces(F.col("text"))).alias("piece"))
    u = vectors(pieces) if vectors else pieces.select(*key, T.embedding(T.tokens(F.col("piece"))).alias("u"))
    return u.join(asks.select("video_id", "q"), "video_id").groupBy(*key).agg(clip01(F.max(dot(F.col("u"), F.col("q")))).alias("dense"))


def channel_scores(texts: DataFrame, phrases: DataFrame, asks: DataFrame, freq: DataFrame, total: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(video_id, step, node, source, text, score): the hybrid score of every text, 0 for those of under five letters."""
    key = ["video_id", "step", "node", "source"]
    s, d = sparse_scores(texts, phrases, freq, total), dense_scores(texts, asks, vectors)
    share = F.coalesce(*(F.when(F.col("source") == k, x) for k, x in SPARSE.items()), F.lit(0.5))
    sparse = F.least(F.lit(1.0), F.coalesce("sparse", F.lit(0.0)) * 1.3)
    score = F.when(F.length(T.trimmed(F.coalesce("text", F.lit("")))) < 5, 0.0).otherwise(clip01(share * sparse + (1 - share) * F.coalesce("dense", F.lit(0.0))))
    return texts.join(s, key, "left").join(d, key, "left").select(*key, "text", score.alias("score"))


def relevance(scored: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(video_id, step, relevance): the best of a step's channels, and of what a model says (video_id, step, said)."""
    best = scored.groupBy("video_id", "step").agg(F.max("score").alias("relevance"))
    if model is None:
        return best
    return best.join(model, ["video_id", "step"], "left").select("video_id", "step", F.greatest("relevance", F.coalesce("said", F.lit(0.0))).alias("relevance"))


def node_of(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """frames (video_id, frame_idx, ...) with the segment that holds them; segments don't overlap, so the last one
    that starts before is the only one to look at."""
    w = Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in frames.columns if c not in ("video_id", "frame_idx")]
    a = nodes.select("video_id", F.col("s").alias("at"), F.lit(0).alias("kind"), F.struct("node", "s", "e").alias("of"), F.lit(None).cast(frames.select(F.struct(F.lit(0).alias("_"), *rest)).schema[0].dataType).alias("rest"))
    b = frames.select("video_id", F.col("frame_idx").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(a.schema["of"].dataType).alias("of"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"))
    met = a.unionByName(b).withColumn("of", F.last("of", ignorenulls=True).over(w)).where("kind = 1 AND of IS NOT NULL AND at <= of.e")
    return met.select("video_id", F.col("at").alias("frame_idx"), *[F.col("rest").getField(c).alias(c) for c in rest], "of.node", "of.s", "of.e")


def brief(scored: DataFrame) -> DataFrame:
    """scored with the start of a text in its place, as a line of evidence shows it, null where it has none; says: more than
    blanks. A text may be long and go to many frames, so it is cut before."""
    flat = T.trimmed(F.regexp_replace("text", r"\s+", " "))
    cut = T.let(flat, lambda x: F.when(F.length(x) > SHOWN, F.concat(F.substring(x, 1, SHOWN), F.lit("..."))).otherwise(x))
    return scored.withColumns({"says": F.coalesce(F.trim("text") != "", F.lit(False)), "text": F.when(F.col("text") != "", cut)})


def shown(source: Column, score: Column, text: Column, s: Column, e: Column, fps: float = 1.0) -> Column:
    """A line of evidence: when, from which channel, how good, and the start of the text."""
    return F.concat(F.format_string("[%.1f-%.1fs] ", s / F.lit(fps), e / F.lit(fps)), F.upper(source), F.format_string("(%.2f): ", score), text)


def best_channel(scored: DataFrame) -> DataFrame:
    """(video_id, step, source, score, text, says): a step's channel of the highest score; ties in the order of CHANNELS."""
    rank = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("source"))
    best = F.max_by(F.struct("source", "score", "text", "says"), F.struct("score", -rank))
    return brief(scored).groupBy("video_id", "step").agg(best.alias("b")).select("video_id", "step", "b.*")


def best_visit(visits: DataFrame) -> DataFrame:
    """(video_id, node, step): of a node's visits (video_id, step, node, relevance) the most relevant, the first on ties."""
    return visits.groupBy("video_id", "node").agg(F.max_by("step", F.struct("relevance", -F.col("step"))).alias("step"))


def evidence_lines(visits: DataFrame, scored: DataFrame, placed: DataFrame) -> DataFrame:
    """(video_id, pos, line): evidence of visited segments, at the first chosen frame of each.

    visits: (video_id, step, node, relevance); placed: chosen frames (video_id, pos, frame_idx, node, s, e). Channels
    that score nothing or have no text give none.
    """
    told = best_visit(visits).join(best_channel(scored), ["video_id", "step"]).where("score > 0 AND says")
    first = placed.groupBy("video_id", "node").agg(F.min("pos").alias("pos"), F.first("s").alias("s"), F.first("e").alias("e"))
    return told.join(first, ["video_id", "node"]).select("video_id", "pos", shown(F.col("source"), F.col("score"), F.col("text"), F.col("s"), F.col("e")).alias("line"))


def filled_lines(lines: DataFrame, visits: DataFrame, scored: DataFrame, others: DataFrame, placed: DataFrame) -> DataFrame:
    """lines, and one for every other position that something is known of.

    A visited segment's best channel; where that has no text, the better of others (video_id, node, source, score, text),
    what was heard first on ties. A score of 0 is shown as 0.01.
    """
    free = placed.join(lines.select("video_id", "pos").distinct(), ["video_id", "pos"], "left_anti")
    own = best_visit(visits).join(best_channel(scored), ["video_id", "step"]).where("text IS NOT NULL").select("video_id", "node", F.struct("source", "score", "text", "says").alias("own"))
    order = F.struct("score", F.when(F.col("source") == "asr", 1).otherwise(0))
    rest = brief(others.where("score > 0")).groupBy("video_id", "node").agg(F.max_by(F.struct("source", "score", "text", "says"), order).alias("rest"))
    got = free.join(own, ["video_id", "node"], "left").join(rest, ["video_id", "node"], "left").withColumn("b", F.coalesce("own", "rest")).where("b.says")
    score = F.when(F.col("b.score") <= 0, 0.01).otherwise(F.col("b.score"))
    more = got.select("video_id", "pos", shown(F.col("b.source"), score, F.col("b.text"), F.col("s"), F.col("e")).alias("line"))
    return lines.unionByName(more)


def caption_lines(visits: DataFrame, placed: DataFrame, fps: float = 1.0) -> DataFrame:
    """(video_id, pos, line): every caption of a visited segment (video_id, step, node, caption), at all its frames."""
    line = F.concat(F.format_string("[%.1fs-%.1fs]: ", F.col("s") / F.lit(fps), F.col("e") / F.lit(fps)), "caption")
    each = visits.where("coalesce(caption, '') <> ''").join(placed, ["video_id", "node"]).select("video_id", "pos", line.alias("line"), "step")
    return each.groupBy("video_id", "pos", "line").agg(F.min("step").alias("step"))


def heard_by_frame(said: DataFrame) -> DataFrame:
    """(video_id, frame, said): what is spoken at a frame. said: (video_id, start, end, text), in whole seconds and
    frames. Blank texts are left out; a text that what was said before already holds isn't repeated."""
    each = said.where("text IS NOT NULL AND text <> ''").select("video_id", "start", F.explode(F.sequence("start", "end")).alias("frame"), "text")
    order = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"])
    join = F.aggregate("t", F.lit(""), lambda a, x: F.when(F.contains(a, x), a).when(a == "", x).otherwise(F.concat(a, F.lit(" "), x)))
    return each.groupBy("video_id", "frame").agg(order.alias("t")).select("video_id", "frame", join.alias("said"))


def heard_in_nodes(by_frame: DataFrame, nodes: DataFrame) -> DataFrame:
    """(video_id, node, text): the different texts of a segment's frames in their order, as one."""
    at = node_of(by_frame.select("video_id", F.col("frame").cast("int").alias("frame_idx"), "said"), nodes)
    once = at.groupBy("video_id", "node", "said").agg(F.min("frame_idx").alias("k"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x["said"])
    return once.groupBy("video_id", "node").agg(F.array_join(texts, " ").alias("text"))
