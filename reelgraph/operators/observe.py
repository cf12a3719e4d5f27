"""The observation loop over a video's segments, and how the frames of an answer are filled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions.vectors import clip01, dot, uniform_indices
from reelgraph.operators import rounds
from reelgraph.operators.graph import frames_of
from reelgraph.operators.selection import option_anchors
from reelgraph.workers import Scratch, kept

#: The option number under which channels hold the scores of the question itself.
QUESTION = -1


def patrol(edges: DataFrame, prior: DataFrame, channels: DataFrame, answers: DataFrame, most: int = 10, weak: float = 0.2) -> DataFrame:
    """(video_id, step, node, option, relevance, belief): which segments are looked at, in order.

    edges: (video_id, i, j, w_norm); prior: (video_id, node, score), segments from 0 on; channels: (video_id, option, node,
    score), option QUESTION for the question; answers: (video_id, node, relevance), what a model says of a segment, 0 where it says
    nothing. First the question's best segment, then one for each option; an option whose segment is weak gets its
    next best one at once. What is left of the most steps goes to unseen segments of the highest belief, while above
    0. After each step the relevance takes the prior's place and beliefs spread again. All videos take a step at a time.
    """
    with Scratch(edges.sparkSession) as scratch:
        nodes = prior.select("video_id", "node", F.col("node").alias("s"), F.col("node").alias("e"))
        own = channels.where(F.col("option") != QUESTION)
        best = F.max_by("node", F.struct(F.round("score", 9), -F.col("node"))).alias("node")
        question = channels.where(F.col("option") == QUESTION).groupBy("video_id").agg(best)
        anchors = option_anchors(own, in_turn=True)
        said = answers.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "relevance"))).alias("said"))
        searches = prior.select("video_id").distinct().withColumn("most", F.lit(most)).join(said, "video_id", "left")
        state = rounds.started(rounds.graphs(nodes, edges), prior, own, question, anchors, searches)
        told = lambda rows, _: rows.withColumn("relevance", F.coalesce(F.try_element_at("said", "node"), F.lit(0.0)))
        looks, ends = rounds.run(state, told, kept, weak)
        if looks is None:
            looks = ends.selectExpr("*", "0 AS step", "node AS looked_at", "0 AS option", "0.0D AS relevance", "0.0D AS belief").where("false")
        return scratch.keep(looks.select("video_id", "step", F.col("looked_at").alias("node"), "option", "relevance", "belief"))


def best_of_options(observed: DataFrame) -> DataFrame:
    """(video_id, option, node): the most relevant segment seen for an option; the earliest on ties."""
    order = F.struct(F.round("relevance", 9), -F.col("step"))
    return observed.where("option IS NOT NULL").groupBy("video_id", "option").agg(F.max_by("node", order).alias("node"))


def frames_by_score(nodes: DataFrame, chosen: DataFrame, scores: DataFrame, per_node: int = 4) -> DataFrame:
    """(video_id, node, frame_idx): each chosen segment's frames of the highest score (video_id, frame_idx, x)."""
    each = nodes.join(chosen.select("video_id", "node").distinct(), ["video_id", "node"]).select("video_id", "node", F.explode(F.sequence("s", "e")).alias("frame_idx"))
    w = Window.partitionBy("video_id", "node").orderBy(F.desc(F.round("x", 9)), "frame_idx")
    return each.join(scores, ["video_id", "frame_idx"]).withColumn("r", F.row_number().over(w)).where(f"r <= {per_node}").select("video_id", "node", "frame_idx")


def option_pack(nodes: DataFrame, best: DataFrame, anchors: DataFrame, channels: DataFrame, options: int, budget: int = 32, per_node: int = 4) -> DataFrame:
    """(video_id, option, pos, frame_idx): frames for each option in turn; then, option null, evenly spread ones.

    An option's segments are its best one, its anchor and then the others by score, as many as its share of the
    budget fills. An option may repeat frames of another; the even ones fill what is left without repeating any.
    """
    share = max(1, budget // options)
    many = max(1, share // per_node)
    by_score = channels.where("score > 0").select("video_id", "option", "node", F.lit(2).alias("turn"), F.round("score", 9).alias("score"))
    first = lambda t, k: t.select("video_id", "option", "node", F.lit(k).alias("turn"), F.lit(0.0).alias("score"))
    every = first(best, 0).unionByName(first(anchors, 1)).unionByName(by_score)
    once = every.groupBy("video_id", "option", "node").agg(F.min(F.struct("turn", (-F.col("score")).alias("k"))).alias("o"))
    w = Window.partitionBy("video_id", "option").orderBy("o", "node")
    ranked = once.withColumn("r", F.row_number().over(w)).where(f"r <= {many}").select("video_id", "option", "node", "r")
    frames = frames_of(nodes, ranked.select("video_id", "node").distinct(), per_node)
    spans = nodes.select("video_id", "node", "s", "e")
    of = frames.join(spans, "video_id").where("frame_idx BETWEEN s AND e").select("video_id", "node", "frame_idx").join(ranked, ["video_id", "node"])
    own = of.withColumn("k", F.row_number().over(Window.partitionBy("video_id", "option").orderBy("r", "frame_idx"))).where(f"k <= {share}")
    own = own.withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("option", "k"))).select("video_id", "option", "pos", "frame_idx")
    have = own.groupBy("video_id").agg(F.count("*").alias("n"), F.collect_set("frame_idx").alias("used"))
    total = nodes.groupBy("video_id").agg((F.max("e") + 1).alias("frames")).join(have, "video_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("int")
    # A list for each possible number of missing frames: the budget bounds them.
    even = F.element_at(F.array(*(uniform_indices(F.col("frames"), k) for k in range(1, budget + 1))), F.greatest(F.lit(budget) - n, F.lit(1)))
    more = total.where(n < budget).select("video_id", n.alias("n"), F.posexplode(F.array_except(even, F.coalesce("used", F.array().cast("array<int>")))).alias("k", "frame_idx"))
    more = more.select("video_id", F.lit(None).cast("int").alias("option"), (F.col("n") + F.col("k") + 1).cast("int").alias("pos"), "frame_idx")
    return own.unionByName(more).where(f"pos <= {budget}")


def unlike_first(frames: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(video_id, frame_idx): a video's first frame, and those not more similar to it than threshold."""
    lead = frames.groupBy("video_id").agg(F.min_by("v", "frame_idx").alias("v0"), F.min("frame_idx").alias("i0"))
    return frames.join(lead, "video_id").where((F.col("frame_idx") == F.col("i0")) | (F.round(dot(F.col("v"), F.col("v0")), 9) <= threshold)).select("video_id", "frame_idx")


def diversity_fill(frames: DataFrame, chosen: DataFrame, scores: DataFrame, budget: int = 32, near: float = 0.9, most: int | None = None) -> DataFrame:
    """(video_id, frame_idx, filled): the chosen frames, filled up to the budget with the best of the others.

    Worth is 0.7 of the distance (1 less the least similarity to a chosen frame, in [0, 1]) and 0.3 of the score
    (video_id, frame_idx, x; 0.5 without). The first and last twentieth and those as near as near don't count.
    Each frame meets the chosen ones of its video only, so at most budget rows for each. most: no more than so many are
    filled in, however few are chosen.
    """
    size = frames.groupBy("video_id").agg(F.count("*").alias("size"))
    have = chosen.groupBy("video_id").agg(F.count("*").alias("have"))
    at = frames.join(chosen.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi").select("video_id", F.col("v").alias("c"))
    rest = frames.join(size, "video_id").where("frame_idx >= size * 0.05 AND frame_idx <= size * 0.95").join(chosen.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")
    least = rest.join(at, "video_id", "left").groupBy("video_id", "frame_idx").agg(clip01(F.least(F.coalesce(F.min(dot(F.col("v"), F.col("c"))), F.lit(1.0)), F.lit(1.0))).alias("sim"))
    worth = F.round(0.7 * (1 - F.col("sim")) + 0.3 * F.coalesce("x", F.lit(0.5)), 9)
    scored = least.join(scores, ["video_id", "frame_idx"], "left").where(F.round("sim", 9) < near)
    w = Window.partitionBy("video_id").orderBy(F.desc("worth"), "frame_idx")
    more = scored.withColumn("worth", worth).withColumn("r", F.row_number().over(w)).join(have, "video_id", "left")
    more = more.where((F.col("r") + F.coalesce("have", F.lit(0)) <= budget) & (F.col("r") <= (budget if most is None else most)))
    return chosen.select("video_id", "frame_idx", F.lit(False).alias("filled")).unionByName(more.select("video_id", "frame_idx", F.lit(True).alias("filled")))
