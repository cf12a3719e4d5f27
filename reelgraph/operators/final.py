"""The last choice: which segments are sure of a place, and which frames an answer is given from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.workers import reachable


def uniform_share(budget: int, bonus: Column, least: int = 4) -> Column:
    """How many frames of the budget are spread evenly: a few, and the bonus of the question's kind, leaving 8."""
    return F.least(F.lit(least) + bonus, F.lit(max(least, budget - 8)))


def mixed(even: DataFrame, recalled: DataFrame, budget: int) -> DataFrame:
    """(video_id, frame_idx, even): evenly spread frames (video_id, frame_idx, share), and of the recalled ones
    (video_id, frame_idx) the earliest that the rest of the budget holds, without those that are there already."""
    share = even.groupBy("video_id").agg(F.max("share").alias("share"))
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    early = recalled.withColumn("r", F.row_number().over(w)).join(share, "video_id", "left").where(F.col("r") <= F.greatest(F.lit(budget) - F.coalesce("share", F.lit(0)), F.lit(0)))
    more = early.select("video_id", "frame_idx").join(even.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")
    return even.select("video_id", "frame_idx", F.lit(True).alias("even")).unionByName(more.select("video_id", "frame_idx", F.lit(False).alias("even")))


def merged(selected: Column, frames: Column, budget: int) -> Column:
    """Chosen frames and then evenly spread ones, each once, cut to the budget, in order."""
    return F.array_sort(F.slice(F.array_distinct(F.concat(selected, frames)), 1, budget)) if budget > 0 else F.array().cast("array<int>")


def guaranteed(best: DataFrame, anchor: DataFrame, ranked: DataFrame, budget: int = 32) -> DataFrame:
    """(video_id, pos, node): segments sure of a place, then the best of the others.

    best: (video_id, option, node), a node for each option; anchor: (video_id, node) of the question; ranked:
    (video_id, rank, node). A node of two options has two places. max(8, budget / 4) in all, unless the sure ones are more.
    """
    many = max(8, budget // 4)
    w = Window.partitionBy("video_id").orderBy("kind", "k")
    sure = best.select("video_id", F.lit(0).alias("kind"), F.col("option").alias("k"), "node")
    own = anchor.join(best.select("video_id", "node").distinct(), ["video_id", "node"], "left_anti").select("video_id", F.lit(1).alias("kind"), F.lit(0).alias("k"), "node")
    sure = sure.unionByName(own)
    # As many are asked for as places are left, and four more; those with a place already fall out.
    have = sure.groupBy("video_id").agg(F.count("*").alias("have"))
    rest = ranked.join(have, "video_id", "left").where(F.col("rank") <= F.lit(many + 4) - F.coalesce("have", F.lit(0)))
    rest = rest.where(F.coalesce("have", F.lit(0)) < many).join(sure.select("video_id", "node").distinct(), ["video_id", "node"], "left_anti").select("video_id", F.lit(2).alias("kind"), F.col("rank").alias("k"), "node")
    every = sure.unionByName(rest).withColumn("pos", F.row_number().over(w))
    return every.where(f"kind < 2 OR pos <= {many}").select("video_id", "pos", "node")


def picked(x: np.ndarray, even: list[int], recalled: list[int], scores: np.ndarray | None, budget: int = 32, first: float = 0.92, every: float = 0.95, near: float = 0.9) -> list[int]:
    """Frames of one video: the even ones, then recalled ones unlike the first of all, then those unlike every chosen
    one, then others by distance to the chosen ones and score. Sorted, at most budget of them."""
    out = [i for i in even if i < len(x)]
    have = set(out)
    for i in recalled:
        if len(out) >= budget:
            break
        if i not in have and i < len(x) and not (out and x[i] @ x[out[0]] > first):
            out.append(i)
            have.add(i)
    for i in recalled:
        if len(out) >= budget:
            break
        if i not in have and i < len(x) and not (out and (x[out] @ x[i]).max() > every):
            out.append(i)
            have.add(i)
    if len(out) < budget and len(x):
        rest = np.array([i for i in range(len(x)) if i not in have and len(x) * 0.05 <= i <= len(x) * 0.95], np.int64)
        least = np.clip((x[rest] @ x[out].T).min(axis=1) if out else np.ones(len(rest)), 0, 1)
        worth = 0.7 * (1 - least) + 0.3 * (scores[rest] if scores is not None else 0.5)
        for k in np.argsort(-np.round(worth, 9), kind="stable").tolist():
            if len(out) >= budget:
                break
            if np.round(least[k], 9) < near:
                out.append(int(rest[k]))
    return sorted(out)[:budget]


def final_frames(frames: DataFrame, mix: DataFrame, scores: DataFrame, budget: int = 32, first: float = 0.92, every: float = 0.95, near: float = 0.9) -> DataFrame:
    """(video_id, frame_idx): picked() for every video. frames: (video_id, frame_idx, v), frame_idx from 0 on without
    gaps; mix: (video_id, frame_idx, even); scores: (video_id, frame_idx, x). One video to a group."""
    reachable(frames.sparkSession)
    rows = frames.join(scores, ["video_id", "frame_idx"], "left").join(mix, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", "v", "x", "even")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx").reset_index(drop=True)
        x = np.stack(pdf["v"].to_numpy())
        s = pdf["x"].to_numpy(np.float64)
        out = picked(x, pdf.index[pdf["even"] == True].tolist(), pdf.index[pdf["even"] == False].tolist(), np.where(np.isnan(s), 0.5, s), budget, first, every, near)  # noqa: E712
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "frame_idx": pdf["frame_idx"].to_numpy()[out]})

    return rows.groupBy("video_id").applyInPandas(run, "video_id long, frame_idx int")
