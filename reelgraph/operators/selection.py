"""Greedy choices within a video, and the belief over its frames as observations come in."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions.vectors import clip01, dot
from reelgraph.workers import kept, reachable

#: Observations that belief_history() unrolls at once.
BLOCK = 64


def _falling(key: str, *more: str) -> Column:
    """All rows of the group, the highest key first; ties by the columns that follow."""
    return F.array_sort(F.collect_list(F.struct((-F.round(key, 9)).alias("k"), *more)))


def masked(scores: DataFrame, visited: DataFrame | None) -> DataFrame:
    """scores (video_id, option, node, score) with 0 for visited nodes (video_id, node)."""
    if visited is None:
        return scores
    gone = visited.select("video_id", "node", F.lit(True).alias("gone")).distinct()
    return scores.join(gone, ["video_id", "node"], "left").select("video_id", "option", "node", F.when(F.col("gone"), 0.0).otherwise(F.col("score")).alias("score"))


def option_anchors(scores: DataFrame, visited: DataFrame | None = None, masked_first: bool = False, in_turn: bool = False) -> DataFrame:
    """(video_id, option, node), with in_turn also turn, when an option took it (from 0): options by their best score, each takes its best node that none has taken
    yet, or its best one where none is left; visited nodes score 0. scores: (video_id, option, node, score).
    masked_first: the order of options counts visited nodes as 0, too."""
    rest = masked(scores, visited)
    each = rest.groupBy("video_id", "option").agg(F.transform(_falling("score", "node"), lambda x: x["node"]).alias("nodes"))
    top = (rest if masked_first else scores).groupBy("video_id", "option").agg(F.max("score").alias("top"))
    every = each.join(top, ["video_id", "option"]).groupBy("video_id").agg(_falling("top", "option", "nodes").alias("o"))

    def take(taken, x):
        free = F.filter(x["nodes"], lambda n: ~F.exists(taken, lambda t: t["node"] == n))
        return F.concat(taken, F.array(F.struct(x["option"].alias("option"), F.coalesce(F.get(free, F.lit(0)), x["nodes"][0]).alias("node"))))

    start = F.array().cast("array<struct<option:int,node:int>>")
    if in_turn:
        return every.select("video_id", F.posexplode(F.aggregate("o", start, take)).alias("turn", "p")).select("video_id", "p.option", "p.node", "turn")
    return every.select("video_id", F.inline(F.aggregate("o", start, take)))


def candidates(scores: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(video_id, option, node, rank): an option's nodes by score, without those that score 0 or were visited."""
    w = Window.partitionBy("video_id", "option").orderBy(F.desc(F.round("score", 9)), "node")
    return masked(scores, visited).where("round(score, 9) > 0").select("video_id", "option", "node", F.row_number().over(w).alias("rank"))


def search(nodes: DataFrame, keywords: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(video_id, node): the node nearest to any of a video's keywords (video_id, option, kv). A visited node counts
    as 0, so it wins where all others are below; ties: the least node."""
    best = nodes.select("video_id", "node", "v").join(keywords.select("video_id", "kv"), "video_id").groupBy("video_id", "node").agg(F.max(dot(F.col("v"), F.col("kv"))).alias("score"))
    rest = masked(best.withColumn("option", F.lit(None).cast("int")), visited)
    return rest.groupBy("video_id").agg(F.max_by("node", F.struct(F.round("score", 9), -F.col("node"))).alias("node"))


def find_peaks(curve: DataFrame, k: int, distance: int = 1) -> DataFrame:
    """(video_id, frame_idx): the highest values of the curve x, at least distance frames apart."""
    far = lambda got, i: ~F.exists(got, lambda g: F.abs(g - i) < distance)
    every = curve.groupBy("video_id").agg(_falling("x", "frame_idx").alias("c"))
    got = F.aggregate("c", F.array().cast("array<int>"), lambda a, x: F.when((F.size(a) < k) & far(a, x["frame_idx"]), F.array_append(a, x["frame_idx"])).otherwise(a))
    return every.select("video_id", F.explode(got).alias("frame_idx"))


def update_belief(belief: DataFrame, observed: DataFrame, hit: float = 0.6) -> DataFrame:
    """belief (video_id, frame_idx, mu, sigma) after all observations (video_id, step, t, relevance), in order of
    step: doubt falls around t; a hit lifts mu there, a miss lowers it. Each frame folds for itself."""
    seen = observed.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("step", "t", "relevance"))).alias("seen"))

    def bump(o, width: float) -> Column:
        return F.exp(-F.pow(F.col("frame_idx") - o["t"], F.lit(2.0)) / F.lit(2 * width * width))

    def step(b, o):
        mu = F.when(o["relevance"] > hit, b["mu"] + o["relevance"] * bump(o, 1.5)).otherwise(b["mu"] * (1 - 0.5 * bump(o, 4.0)))
        return F.struct(clip01(mu).alias("mu"), clip01(b["sigma"] * (1 - bump(o, 4.0))).alias("sigma"))

    now = F.aggregate(F.coalesce("seen", F.array().cast("array<struct<step:int,t:int,relevance:double>>")), F.struct("mu", "sigma"), step)
    return belief.join(seen, "video_id", "left").withColumn("b", now).select("video_id", "frame_idx", F.col("b.mu").alias("mu"), F.col("b.sigma").alias("sigma"))


def next_step(belief: DataFrame, visited: DataFrame, beta: float = 1.0, distance: int = 3) -> DataFrame:
    """(video_id, frame_idx): the highest mu + beta * sigma farther than distance from all visited frames (video_id, t);
    the highest of all where none is so far. Ties: the least frame."""
    near = visited.groupBy("video_id").agg(F.collect_set("t").alias("near"))
    free = ~F.coalesce(F.exists("near", lambda t: F.abs(t - F.col("frame_idx")) <= distance), F.lit(False))
    best = F.struct(free, F.round(F.col("mu") + beta * F.col("sigma"), 9), -F.col("frame_idx"))
    return belief.join(near, "video_id", "left").groupBy("video_id").agg(F.max_by("frame_idx", best).alias("frame_idx"))


def drop_similar(frames: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(video_id, frame_idx): in order of time, frames not more similar than threshold to any kept before."""
    every = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "v"))).alias("f"))
    start = F.array().cast("array<struct<frame_idx:int,v:array<double>>>")
    kept = F.aggregate("f", start, lambda a, x: F.when(F.exists(a, lambda y: dot(y["v"], x["v"]) > threshold), a).otherwise(F.array_append(a, x)))
    return every.select("video_id", F.explode(kept["frame_idx"]).alias("frame_idx"))


def diverse(frames: DataFrame, k: int = 8, weight: float = 0.3) -> DataFrame:
    """(video_id, frame_idx): first the frame most similar to all on average, then again and again the best of
    that mean less weight times the greatest similarity to those chosen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        x = np.stack(pdf["v"].to_numpy())
        mean = x @ x.sum(axis=0) / len(x)
        chosen, close, left = [], np.zeros(len(x)), np.full(len(x), 0.0)
        for _ in range(min(k, len(x))):
            i = int(np.round(mean - weight * close + left, 9).argmax())
            sim = x @ x[i]
            close = np.maximum(close, sim) if chosen else sim
            left[i] = -np.inf
            chosen.append(i)
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "frame_idx": pdf["frame_idx"].to_numpy()[sorted(chosen)]})

    return frames.select("video_id", "frame_idx", "v").groupBy("video_id").applyInPandas(run, "video_id long, frame_idx int")


def semantic_scores(nodes: DataFrame, captions: DataFrame, queries: DataFrame) -> DataFrame:
    """(video_id, option, node, score): similarity of an option's query (video_id, option, q) and the captions
    (video_id, node, c), 0 without one, rescaled to [0, 1] over the nodes of a video; cut to [0, 1] where all are alike."""
    s = nodes.select("video_id", "node").join(captions, ["video_id", "node"], "left").join(queries, "video_id")
    s = s.select("video_id", "option", "node", F.coalesce(dot(F.col("c"), F.col("q")), F.lit(0.0)).alias("x"))
    span = s.groupBy("video_id", "option").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("hi") - F.col("lo") < 1e-8
    return s.join(span, ["video_id", "option"]).select("video_id", "option", "node", F.when(flat, clip01(F.col("x"))).otherwise((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))


def fuse(visual: DataFrame, semantic: DataFrame, alpha: float = 0.6) -> DataFrame:
    """(video_id, option, node, score): alpha of one and the rest of the other; 0 where a node has none."""
    key = ["video_id", "option", "node"]
    v, s = visual.select(*key, F.col("score").alias("a")), semantic.select(*key, F.col("score").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return v.join(s, key, "full").select(*key, (alpha * zero("a") + (1 - alpha) * zero("b")).alias("score"))


def _unrolled(batch: pa.RecordBatch, hit: float) -> tuple[np.ndarray, ...]:
    """(steps, there, scale, more, left) of rows (frame_idx, seen): each observation's step, whether a row has so many, what it
    multiplies and adds to mu, and what it leaves of sigma."""
    seen = batch.column("seen")
    start, n = seen.offsets.to_numpy()[:-1], np.diff(seen.offsets.to_numpy())
    k = np.arange(BLOCK)
    there = k < n[:, None]
    at = np.where(there, start[:, None] + k, start[:, None])
    step, t, r = (seen.values.field(c).to_numpy(zero_copy_only=False)[at] for c in ("step", "t", "relevance"))
    # Beyond 255 frames both are 0.
    near = np.minimum(np.abs(batch.column("frame_idx").to_numpy()[:, None] - t), 255).astype(int)
    narrow, wide = (np.array([math.exp(-(d**2.0) / (2 * w * w)) for d in range(256)])[near] for w in (1.5, 4.0))
    up = r > hit
    return step, there, np.where(up, 1.0, 1 - 0.5 * wide), np.where(up, r * narrow, 0.0), 1 - wide


def belief_history(belief: DataFrame, observed: DataFrame, hit: float = 0.6) -> DataFrame:
    """(video_id, step, frame_idx, mu, sigma): the belief after every observation, step 0 before any. As many rows as
    frames times steps; update_belief() keeps only the last.

    Observations go in blocks of BLOCK. What a block does to a frame is known without the belief before it: mu becomes
    a * mu + b, cut to [lo, hi], sigma s * sigma, cut to [0, 1]. So a video's blocks are joined up frame by frame from those
    numbers, and then each is unrolled for itself from the belief that it starts with.
    """
    reachable(belief.sparkSession)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("step"))
    blocks = observed.select("video_id", "step", "t", "relevance", F.floor((place - 1) / BLOCK).cast("int").alias("block"))
    blocks = kept(blocks.groupBy("video_id", "block").agg(F.array_sort(F.collect_list(F.struct("step", "t", "relevance"))).alias("seen")))
    belief = kept(belief.select("video_id", "frame_idx", "mu", "sigma"))
    # A task unrolls so many blocks of a frame.
    tasks = belief.join(blocks.select("video_id"), "video_id").count() // 16384 + 1

    def effects(batches):
        for batch in batches:
            _, there, scale, more, left = _unrolled(batch, hit)
            a, b, lo, hi, s = (np.full(len(there), x) for x in (1.0, 0.0, -np.inf, np.inf, 1.0))
            for k in range(BLOCK):
                x, m, on = scale[:, k], more[:, k], there[:, k]
                a, b, s = np.where(on, a * x, a), np.where(on, b * x + m, b), np.where(on, s * left[:, k], s)
                lo, hi = (np.where(on, np.clip(y * x + m, 0, 1), y) for y in (lo, hi))
            rest = [batch.column(c) for c in ("video_id", "frame_idx", "block", "mu", "sigma")]
            yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, (a, b, lo, hi, s))], names=["video_id", "frame_idx", "block", "mu", "sigma", "a", "b", "lo", "hi", "s"])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        """mu and sigma before each block of one frame."""
        pdf = pdf.sort_values("block")
        mu, sigma, before = pdf["mu"].iloc[0], pdf["sigma"].iloc[0], []
        for a, b, lo, hi, s in zip(*(pdf[k].to_numpy().tolist() for k in ("a", "b", "lo", "hi", "s")), strict=True):
            before.append((mu, sigma))
            mu, sigma = min(max(a * mu + b, lo), hi), min(max(s * sigma, 0.0), 1.0)
        return pdf[["video_id", "frame_idx", "block"]].assign(mu=[m for m, _ in before], sigma=[x for _, x in before])

    def unrolled(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                step, there, scale, more, left = _unrolled(batch, hit)
                mu, sigma, rows = batch.column("mu").to_numpy(), batch.column("sigma").to_numpy(), []
                for k in range(BLOCK):
                    mu, sigma = np.clip(mu * scale[:, k] + more[:, k], 0, 1), np.clip(sigma * left[:, k], 0, 1)
                    rows.append((mu, sigma))
                flat = [np.stack(x, axis=1)[there] for x in zip(*rows, strict=True)]
                ids = [np.repeat(batch.column(c).to_numpy(), there.sum(axis=1)) for c in ("video_id", "frame_idx")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[0], step[there].astype(np.int32), ids[1], *flat)], names=["video_id", "step", "frame_idx", "mu", "sigma"])

    state = "video_id long, frame_idx int, block int, mu double, sigma double"
    done = blocks.repartition(tasks).join(belief, "video_id").select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), "block", "mu", "sigma", "seen")
    done = done.mapInArrow(effects, f"{state}, a double, b double, lo double, hi double, s double")
    before = done.groupBy("video_id", "frame_idx").applyInPandas(starts, state)
    after = before.repartition(tasks, "video_id", "block").join(blocks, ["video_id", "block"]).select("video_id", "frame_idx", "mu", "sigma", "seen")
    after = after.mapInArrow(unrolled, "video_id long, step int, frame_idx int, mu double, sigma double")
    return belief.select("video_id", F.lit(0).alias("step"), "frame_idx", "mu", "sigma").unionByName(after)


def confidence(belief: DataFrame, observed: DataFrame, relevance: float = 0.9, sure: float = 0.95) -> DataFrame:
    """(video_id, confidence, stop): the highest mu, and whether to stop: the last observation was relevant and that
    is high. Without observations: no."""
    top = belief.groupBy("video_id").agg(F.coalesce(F.max("mu"), F.lit(0.0)).alias("confidence"))
    last = observed.groupBy("video_id").agg(F.max_by("relevance", "step").alias("last"))
    stop = F.coalesce((F.col("last") > relevance) & (F.round("confidence", 9) > sure), F.lit(False))
    return top.join(last, "video_id", "left").select("video_id", "confidence", stop.alias("stop"))


def spectral_anchors(frames: DataFrame, k: int = 8, gamma: float = 0.001, queries: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(video_id, frame_idx): one frame for each of k clusters of a video's frames, all frames of a video of k or fewer.

    Clusters are those of the leading eigenvectors of the affinity max(0, similarity * exp(-gamma * distance^2)), scaled
    by its degrees. The frame is the one nearest to the video's query (video_id, q), or the cluster's medoid. A frame
    matrix must fit a task, so this is for sampled frames.
    """
    reachable(frames.sparkSession)
    given = queries if queries is not None else frames.sparkSession.createDataFrame([], "video_id long, q array<double>")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("frame_idx")
        if not len(left):
            return pd.DataFrame({"video_id": pd.Series([], dtype="int64"), "frame_idx": pd.Series([], dtype="int32")})
        ids, x = left["frame_idx"].to_numpy(), np.stack(left["v"].to_numpy())
        n, out = len(x), list(range(len(x)))
        if n > k:
            sim, at = x @ x.T, np.arange(n)
            a = np.clip(sim * np.exp(-gamma * (at[:, None] - at) ** 2.0), 0, None)
            root = np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
            lead = np.linalg.eigh(a / root[:, None] / root)[1][:, -k:] / root[:, None]
            lead /= np.maximum(np.sqrt((lead * lead).sum(axis=1, keepdims=True)), 1e-12)
            rng = np.random.default_rng(seed)
            centres = lead[[int(rng.integers(n))]]
            while len(centres) < k:  # the farthest point from all centres is the next
                centres = np.vstack((centres, lead[[((lead[:, None] - centres) ** 2).sum(axis=2).min(axis=1).argmax()]]))
            for _ in range(100):
                label = ((lead[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
                new = np.array([lead[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
                if np.allclose(new, centres):
                    break
                centres = new
            out = []
            for c in range(k):
                own = np.flatnonzero(label == c)
                if len(own):
                    worth = x[own] @ right["q"].iloc[0] if len(right) else sim[np.ix_(own, own)].sum(axis=1) - sim[own, own]
                    out.append(int(own[np.round(worth, 9).argmax()]))
        return pd.DataFrame({"video_id": left["video_id"].iloc[0], "frame_idx": ids[sorted(out)]})

    return frames.select("video_id", "frame_idx", "v").groupBy("video_id").cogroup(given.select("video_id", "q").groupBy("video_id")).applyInPandas(run, "video_id long, frame_idx int")
