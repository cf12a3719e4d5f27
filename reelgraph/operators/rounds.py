"""A search in rounds: the state of every search is a row, and in each round all unfinished ones take one look.

What is looked at next, what a look changes and when a search ends are expressions on the row's arrays; the rows of a round are
written to the shared folder, so a lost executor costs that round at most. A round does not shuffle the state; what observe() finds
out is to come to its rows (see workers.beside).

State: video_id (the key of a search), near array<array<struct<j, w>>> (edges of each segment), y (relevance) and f (belief) by
segment, channels array<array<double>> (scores of segments by option), of array<int> (the option for which a segment
is looked at, or null), seen array<int>, queue array<int> and at (the next place in it), used and most (steps).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relevance below which an option gets its next best segment at once; steps and share of neighbours in a spreading.
WEAK, STEPS, ALPHA = 0.2, 7, 0.6
STATE = ("video_id", "near", "y", "f", "channels", "of", "seen", "queue", "at", "used", "most")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best_place(x: Column, above: float | None = None) -> Column:
    """Place (from 0) of the highest number, the least on ties; null if there is none, or none above the bound."""
    top = F.array_max(x)
    place = (F.array_position(x, top) - 1).cast("int")
    return F.when(F.size(x) > 0, place) if above is None else F.when(top > above, place)


def unseen(x: Column, seen: Column) -> Column:
    """Scores rounded, 0 for seen segments."""
    return F.transform(x, lambda s, k: F.when(F.array_contains(seen, k), 0.0).otherwise(F.round(s, 9)))


def spread(near: Column, y: Column, f: Column, steps: int = STEPS, alpha: float = ALPHA) -> Column:
    """steps times f = alpha * W f + (1 - alpha) * y, starting from y where f is all zero."""
    start = F.when(F.aggregate(f, F.lit(0.0), lambda s, x: s + F.abs(x)) < 1e-8, y).otherwise(f)
    each = lambda now: F.transform(near, lambda row, k: alpha * F.aggregate(row, F.lit(0.0), lambda s, e: s + e["w"] * F.get(now, e["j"])) + (1 - alpha) * F.get(y, k))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda now, _: each(now))


def graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(video_id, first, last, near): a video's segments as arrays in their order, from 0 on without gaps."""
    row = F.array_sort(F.collect_list(F.struct(F.col("j"), F.col("w_norm").alias("w"))))
    own = nodes.select("video_id", "node", "s", "e").join(edges.groupBy("video_id", F.col("i").alias("node")).agg(row.alias("near")), ["video_id", "node"], "left")
    none = F.array().cast("array<struct<j:int,w:double>>")
    every = F.array_sort(F.collect_list(F.struct("node", "s", "e", F.coalesce("near", none).alias("near"))))
    part = lambda c: F.transform("g", lambda x: x[c]).alias({"s": "first", "e": "last"}.get(c, c))
    return own.groupBy("video_id").agg(every.alias("g")).select("video_id", part("s"), part("e"), part("near"))


def following() -> Column:
    """What a search looks at next: the queue's next segment, then the unseen one of the highest belief while that is above 0; null
    at the end."""
    left = F.when(F.col("at") < F.size("queue"), F.get("queue", F.col("at"))).otherwise(best_place(unseen(F.col("f"), F.col("seen")), 0.0))
    return F.when(F.col("used") < F.col("most"), left)


def looked(state: DataFrame, weak: float = WEAK) -> DataFrame:
    """State after looks at the column node with the column relevance; adds option and belief.

    The relevance takes the prior's place and beliefs spread again. A segment of the queue that is weak for its option puts
    the option's best unseen segment behind itself, if that isn't in the queue.
    """
    node = F.col("node")
    here = state.select(*STATE, *[c for c in state.columns if c not in STATE], F.get("of", node).alias("option"), (F.col("at") < F.size("queue")).alias("queued"))
    y = F.transform("y", lambda v, k: F.when(k == node, F.col("relevance")).otherwise(v))
    here = here.withColumns({"y": y, "seen": F.array_append("seen", node)})
    fresh = let(F.col("y"), lambda y: let(F.col("near"), lambda near: spread(near, y, F.col("f"))))
    spare = let(F.get("channels", F.col("option")), lambda s: let(F.col("seen"), lambda seen: best_place(unseen(s, seen), 0.0)))
    spare = F.when(F.col("queued") & F.col("option").isNotNull() & (F.col("relevance") < weak), spare)
    here = here.withColumns({"f": fresh, "spare": spare})
    new = F.col("spare").isNotNull() & ~F.array_contains("queue", F.col("spare"))
    at = F.col("at") + 1
    queue = F.when(new, F.concat(F.slice("queue", F.lit(1), at), F.array("spare"), F.slice("queue", at + 1, F.size("queue")))).otherwise(F.col("queue"))
    of = F.when(new, F.transform("of", lambda o, k: F.when(k == F.col("spare"), F.col("option")).otherwise(o))).otherwise(F.col("of"))
    return here.withColumns({"queue": queue, "of": of, "at": F.when(F.col("queued"), at).otherwise(F.col("at")), "used": F.col("used") + 1, "belief": F.get("f", node)}).drop("queued", "spare")


def taken(anchors: DataFrame) -> DataFrame:
    """(video_id, picks): options with the segments that they took, as structs (option, node) in the order of taking."""
    return anchors.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("turn", "option", "node"))).alias("picks"))


def started(graph: DataFrame, y: DataFrame, channels: DataFrame, question: DataFrame, anchors: DataFrame, most: DataFrame, on: str = "video_id") -> DataFrame:
    """The first state of searches, with f as y spread.

    graph: (video_id, near, ...); y: (video_id, node, score); channels: (video_id, option, node, score), options from 0 on;
    question: (video_id, node), looked at first; anchors: (video_id, option, node, turn); most: (video_id, most). Searches are
    those of most; segments without a score have 0. on: the column of graph and most by which a search has its graph, if many share
    one; a graph is the largest part of a row, so it is joined when all else is there.
    """
    n = F.size("near")
    by_node = lambda t, key: t.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("node", "score"))).alias("scores"))
    full = lambda m: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    rows = by_node(channels, ["video_id", "option"]).groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("option", "scores"))).alias("by_option"))
    out = most.join(by_node(y, ["video_id"]), "video_id", "left").join(rows, "video_id", "left")
    out = out.join(question.select("video_id", F.col("node").alias("lead")), "video_id", "left").join(taken(anchors), "video_id", "left").join(graph, on)
    empty = F.map_from_entries(F.array().cast("array<struct<k:int,v:double>>"))
    options = F.coalesce(F.array_max(F.map_keys("by_option")), F.lit(-1))
    by = F.when(options >= 0, F.transform(F.sequence(F.lit(0), options), lambda o: full(F.coalesce(F.try_element_at("by_option", o), empty)))).otherwise(F.array().cast("array<array<double>>"))
    picks = F.coalesce("picks", F.array().cast("array<struct<turn:int,option:int,node:int>>"))
    queue = F.array_distinct(F.concat(F.when(F.col("lead").isNotNull(), F.array("lead")).otherwise(F.array().cast("array<int>")), F.transform(picks, lambda p: p["node"])))
    of = F.transform("near", lambda _, k: F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.filter(picks, lambda p: p["node"] == k), lambda p: p["option"])), -1))
    rest = [c for c in graph.columns if c not in (on, "near")] + [c for c in most.columns if c not in ("video_id", "most")]
    out = out.select("video_id", "near", full(F.coalesce("scores", empty)).alias("y"), by.alias("channels"), of.alias("of"), F.array().cast("array<int>").alias("seen"), queue.alias("queue"), F.lit(0).alias("at"), F.lit(0).alias("used"), "most", *rest)
    first = let(F.col("y"), lambda y: let(F.col("near"), lambda near: spread(near, y, y)))
    return out.withColumn("f", first).select(*STATE, *rest)


def run(state: DataFrame, observe: Callable[[DataFrame, int], DataFrame], kept: Callable[[DataFrame], DataFrame], weak: float = WEAK, pick: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(looks, ends): the rows of every look (state with node, relevance, option, belief, step), and the last state of each search.

    observe(rows, step): rows with the column node get the column relevance. pick(rows): sets the column node, null where a
    search is over, and may change the state. There are as many rounds as the longest search has steps.
    """
    pick = pick or (lambda rows: rows.withColumn("node", following()))
    now = kept(pick(state))
    looks, ends, step = None, now.where("node IS NULL"), 0
    while not (active := now.where("node IS NOT NULL")).isEmpty():
        step += 1
        active = active.drop("option", "relevance", "belief", "step", "looked_at")
        after = looked(observe(active, step), weak).withColumn("step", F.lit(step)).withColumnRenamed("node", "looked_at")
        now = kept(pick(after))
        looks = now if looks is None else looks.unionByName(now)
        ends = ends.unionByName(now.where("node IS NULL"), allowMissingColumns=True)
    return looks, ends
