"""Segments, the affinity graph over them, relevance and its propagation, and what is selected."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions.vectors import clip01, dot
from reelgraph.operators import kernels as K
from reelgraph.workers import kept, reachable


def adjacent_similarity(frames: DataFrame) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    return frames.withColumn("before", F.lag("v").over(w)).where("before IS NOT NULL").select("video_id", "frame_idx", dot(F.col("before"), F.col("v")).alias("sim"))


def cut(frames: DataFrame, threshold: float = 0.82) -> DataFrame:
    """frames with their segment (node): a new one starts where the similarity to the last frame is below."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    new = F.when(dot(F.lag("v").over(w), F.col("v")) < threshold, 1).otherwise(0)
    return frames.withColumn("new", new).withColumn("node", F.sum("new").over(w).cast("int")).drop("new")


def segments(frames: DataFrame, threshold: float = 0.82, least: int = 10) -> DataFrame:
    """(video_id, node, s, e, v): segments cut at the threshold, those of under least frames joined to a neighbour;
    bounds (inclusive) and the mean vector, of unit length. One video to a group: its frame vectors must fit a task."""
    reachable(frames.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        ids = pdf["frame_idx"].to_numpy()
        a, z, v = K.segments(np.stack(pdf["v"].to_numpy()), threshold, least)
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "node": np.arange(len(a)), "s": ids[a], "e": ids[z], "v": list(v)})

    return frames.select("video_id", "frame_idx", "v").groupBy("video_id").applyInPandas(run, "video_id long, node int, s int, e int, v array<double>")


def affinity(nodes: DataFrame, alpha: float = 0.6, tau: float = 30.0, top: int = 8) -> DataFrame:
    """Edges (video_id, i, j, w, w_norm): visual and temporal closeness, the best of each row (ties: least j),
    both directions halved and summed, then scaled by the degrees of both ends. One video to a group; of its
    similarity matrix only some rows are held at once, and at most 2 * top edges a node come out."""
    reachable(nodes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        i, j, w, w_norm = K.edges(np.stack(pdf["v"].to_numpy()), ((pdf["s"] + pdf["e"]) / 2).to_numpy(), alpha, tau, top)
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "i": ids[i], "j": ids[j], "w": w, "w_norm": w_norm})

    return nodes.select("video_id", "node", "s", "e", "v").groupBy("video_id").applyInPandas(run, "video_id long, i int, j int, w double, w_norm double")


def channel_prior(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """(video_id, option, node, score); option null: over all options, by grouping sets. keywords: (video_id, option,
    kv), any number for an option; they meet the nodes of their own video."""
    each = nodes.select("video_id", "node", "v").join(keywords, "video_id").select("video_id", "node", "option", dot(F.col("v"), F.col("kv")).alias("s"))
    return each.groupingSets([["video_id", "node", "option"], ["video_id", "node"]], "video_id", "node", "option").agg(clip01(F.max("s")).alias("score"))


def _packed(nodes: DataFrame, value: str, edges: DataFrame, weight: str) -> DataFrame:
    """Rows (video_id, i, j, w): j is -1 in the nodes' own."""
    own = nodes.select("video_id", F.col("node").alias("i"), F.lit(-1).alias("j"), F.col(value).alias("w"))
    return own.unionByName(edges.select("video_id", "i", "j", F.col(weight).alias("w")))


def _graph(pdf: pd.DataFrame):
    """(own rows, their values, i, j, w of the edges), i in order."""
    own = pdf[pdf["j"] < 0].sort_values("i")
    e = pdf[pdf["j"] >= 0].sort_values(["i", "j"])
    return own, own["w"].to_numpy(), np.searchsorted(own["i"], e["i"]), np.searchsorted(own["i"], e["j"]), e["w"].to_numpy()


def propagate(edges: DataFrame, prior: DataFrame, steps: int = 7, alpha: float = 0.6) -> DataFrame:
    """(video_id, node, y, f): steps times f = alpha * W f + (1 - alpha) * y, from f = y. One video to a group."""
    reachable(edges.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, y, i, j, w = _graph(pdf)
        return pd.DataFrame({"video_id": own["video_id"], "node": own["i"], "y": y, "f": K.spread(i, j, w, y, y, steps, alpha)})

    return _packed(prior, "score", edges, "w_norm").groupBy("video_id").applyInPandas(run, "video_id long, node int, y double, f double")


def nms(edges: DataFrame, belief: DataFrame, n: int = 8, factor: float = 0.2) -> DataFrame:
    """(video_id, rank, node): the best node again and again, its neighbours damped each time; stops at f <= 0."""
    reachable(edges.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, f, i, j, _ = _graph(pdf)
        out = K.spaced(f, i, j, n, factor)
        return pd.DataFrame({"video_id": own["video_id"].iloc[0], "rank": range(1, len(out) + 1), "node": own["i"].to_numpy()[out]})

    return _packed(belief, "f", edges.where("w > 0"), "w").groupBy("video_id").applyInPandas(run, "video_id long, rank int, node int")


def first_choice(nodes: DataFrame, prior: DataFrame, n: int = 8, factor: float = 0.2, alpha: float = 0.6, tau: float = 30.0, top: int = 8) -> DataFrame:
    """(video_id, rank, node): affinity(), propagate() and nms() of a video in one step, so its edges are made once and
    stay in the task. prior: (video_id, node, score)."""
    reachable(nodes.sparkSession)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"video_id": pd.Series([], dtype="int64"), "rank": pd.Series([], dtype="int32"), "node": pd.Series([], dtype="int32")})
        if not len(left):
            return none
        left = left.sort_values("node").merge(right[["node", "score"]], on="node", how="left")
        y = left["score"].fillna(0.0).to_numpy()
        i, j, _, w_norm = K.edges(np.stack(left["v"].to_numpy()), ((left["s"] + left["e"]) / 2).to_numpy(), alpha, tau, top)
        out = K.spaced(K.spread(i, j, w_norm, y, y), i, j, n, factor)
        return pd.DataFrame({"video_id": left["video_id"].iloc[0], "rank": range(1, len(out) + 1), "node": left["node"].to_numpy()[out]}) if out else none

    return nodes.select("video_id", "node", "s", "e", "v").groupBy("video_id").cogroup(prior.select("video_id", "node", "score").groupBy("video_id")).applyInPandas(run, "video_id long, rank int, node int")


def evidence_frames(frames: DataFrame, keywords: DataFrame, threshold: float = 0.82, least: int = 10, n: int = 8, factor: float = 0.2, per_node: int = 4) -> DataFrame:
    """(video_id, frame_idx): the frames of the segments most relevant to a video's keywords (video_id, option, kv).

    Segments, graph, prior, propagation and choice of a video in one step on its arrays, so frames are read and
    dealt by video once. A video without keywords has no relevance, so no frames.
    """
    reachable(frames.sparkSession)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"video_id": pd.Series([], dtype="int64"), "frame_idx": pd.Series([], dtype="int32")})
        if not len(left) or not len(right):
            return none
        left = left.sort_values("frame_idx")
        ids = left["frame_idx"].to_numpy()
        a, z, v = K.segments(np.stack(left["v"].to_numpy()), threshold, least)
        i, j, _, w_norm = K.edges(v, (ids[a] + ids[z]) / 2)
        y = np.clip((v @ np.stack(right["kv"].to_numpy()).T).max(axis=1), 0, 1)
        chosen = K.spaced(K.spread(i, j, w_norm, y, y), i, j, n, factor)
        out = sorted({x for k in chosen for x in K.frames_of(int(ids[a[k]]), int(ids[z[k]]), per_node)})
        return pd.DataFrame({"video_id": left["video_id"].iloc[0], "frame_idx": out}) if out else none

    return frames.select("video_id", "frame_idx", "v").groupBy("video_id").cogroup(keywords.select("video_id", "kv").groupBy("video_id")).applyInPandas(run, "video_id long, frame_idx int")


def frames_of(nodes: DataFrame, chosen: DataFrame, per_node: int = 4) -> DataFrame:
    """(video_id, frame_idx): up to per_node frames of each chosen segment, evenly spaced."""
    n = F.col("e") - F.col("s") + 1
    idx = F.when(n <= per_node, F.sequence("s", "e")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(per_node - 1)), lambda i: (F.col("s") + i * n / per_node).cast("int")))
    return nodes.join(chosen, ["video_id", "node"]).select("video_id", F.explode(idx).alias("frame_idx")).distinct()


def events_in_segments(events: DataFrame, nodes: DataFrame, width: int = 16) -> DataFrame:
    """(video_id, event_id, node): open intervals that overlap, found by time buckets, so no side is sent whole."""
    b = lambda a, z: F.explode(F.sequence((a / width).cast("int"), (z / width).cast("int")))
    x = events.select("*", b(F.col("start"), F.col("end")).alias("slot"))
    y = nodes.select("video_id", "node", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e")).select("*", b(F.col("s"), F.col("e")).alias("slot"))
    return x.join(y, ["video_id", "slot"]).where("start < e AND s < end").select("video_id", "event_id", "node").distinct()


def fallback(scores: DataFrame, by: str, gap: float = 0.15) -> DataFrame:
    """(by, fallback, reason): whether observations are too weak to choose by; the first rule that fires. scores: (by,
    r); a row with a null r stands for one without observations."""
    a = scores.groupBy(by).agg(F.max("r").alias("mx"), F.avg("r").alias("mean"), F.avg((F.col("r") < 0.2).cast("int")).alias("low"))
    reason = F.when(F.col("mx").isNull(), "none").when(F.col("mx") < 0.4, "max").when(F.col("mean") < 0.2, "mean").when(F.col("mx") - F.col("mean") < gap, "flat").when(F.col("low") > 0.7, "low")
    return a.select(by, reason.isNotNull().alias("fallback"), F.coalesce(reason, F.lit("")).alias("reason"))


#: Frequencies that tfidf() sends to all tasks, the highest first; words of lower ones are weighed apart.
BROADCAST_WORDS = 1 << 20
#: Words of the texts that a task of tfidf() gets; their counts are to fit its memory.
TASK_WORDS = 1 << 19


def most_frequent(freq: DataFrame, most: int) -> Column:
    """Which rows (tok, n) of freq are among the most frequent, cut between powers of two: at most so many."""
    bits = F.length(F.bin("n"))
    least, room = 64, most
    for r in freq.groupBy(bits.alias("k")).agg(F.count("*").alias("c")).orderBy(F.desc("k")).collect():  # 64 rows at most
        room -= r.c
        if room < 0:
            break
        least = r.k
    return bits >= least


def tfidf(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase, score): cosine of tf-idf vectors, over tokens that both have.

    texts: (id, tokens), phrases: (phrase, tokens). Frequencies are of all texts; idf = ln((1 + total) / (1 + n)) + 1. Texts
    without an id have no row. Texts are dealt by id once, as strings (tokens are not empty and hold no blanks), and their words
    are counted, weighed and met with the phrases where they lie. Words that are neither frequent nor of a phrase only add to
    a text's length; these few are counted and weighed apart.
    """
    exploded = lambda t, key: t.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("tok"))
    counted = lambda t, key: t.groupBy(key, "len", "tok").agg(F.count("*").alias("c"))
    freq = kept(texts.select(F.explode("tokens").alias("tok")).groupBy("tok").agg(F.count("*").alias("n")))
    total, words = freq.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()  # two numbers
    idf = F.log((1 + F.lit(total)) / (1 + F.coalesce("n", F.lit(0)))) + 1
    weight = F.col("c") / F.col("len") * idf
    size = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size")

    own = kept(counted(exploded(phrases, "phrase"), "phrase").join(freq, "tok", "left").select("phrase", "tok", weight.alias("w")))
    own = own.join(own.groupBy("phrase").agg(size), "phrase").select("phrase", "tok", (F.col("w") / F.col("size")).alias("wp"))
    asked = kept(own.groupBy("tok").agg(F.collect_list(F.struct("phrase", "wp")).alias("of")))

    texts = texts.where("id IS NOT NULL")
    sent = lambda t, rows: F.broadcast(t) if rows <= 2 * BROADCAST_WORDS else t
    known, rest = F.broadcast(freq), None
    if words > BROADCAST_WORDS:
        marked = freq.join(asked.select("tok", F.lit(True).alias("asked")), "tok", "left")
        marked = kept(marked.select("tok", "n", (most_frequent(freq, BROADCAST_WORDS) | F.col("asked").isNotNull()).alias("first")))
        first = marked.where("first").drop("first")
        known = sent(first, first.count())
        seldom = counted(exploded(texts, "id").join(known.select("tok"), "tok", "left_anti"), "id")
        rest = kept(seldom.join(marked.where("NOT first"), "tok").groupBy("id").agg(F.sum(weight * weight).alias("rest")))
    parts = total // TASK_WORDS
    joined = texts.select("id", F.array_join("tokens", " ").alias("t"))
    dealt = (joined.repartition(parts, "id") if parts > 1 else joined.repartition("id")).select("id", F.filter(F.split("t", " "), lambda x: x != "").alias("tokens"))
    each = counted(exploded(dealt, "id"), "id").join(known, "tok").join(sent(asked, own.count()), "tok", "left").select("id", "tok", weight.alias("w"), "of")
    # A text's length, and its products with the phrases, from the same words.
    term = lambda phrase, x, length: F.struct(phrase.alias("phrase"), x.alias("x"), F.lit(length).alias("own"))
    length = term(F.lit(None).cast(own.schema["phrase"].dataType), F.col("w") * F.col("w"), True)
    products = F.when(F.col("of").isNotNull(), F.transform("of", lambda p: term(p["phrase"], F.col("w") * p["wp"], False)))
    terms = F.when(products.isNull(), F.array(length)).otherwise(F.concat(F.array(length), products))
    parts = each.select("id", F.inline(terms))
    sums = parts.groupBy("id", "own", "phrase").agg(F.sum("x").alias("x"))
    sums = sums.withColumn("size", F.max(F.when(F.col("own"), F.col("x"))).over(Window.partitionBy("id"))).where("NOT own")
    if rest is not None:
        sums = sums.join(rest, "id", "left").withColumn("size", F.col("size") + F.coalesce("rest", F.lit(0.0)))
    return sums.select("id", "phrase", (F.col("x") / F.sqrt("size")).alias("score"))
