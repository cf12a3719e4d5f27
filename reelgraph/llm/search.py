"""Ranked lexical search over compressed postings: an index of shards, and document-at-a-time merging in each.

Index: documents are cut into shards of some SHARD_TOKENS terms where they lie, without a shuffle of texts. In a shard
documents are numbered in the order of their doc_id, and each term has one row with its postings in that order: gaps
between numbers, then frequencies, as variable-length integers. One more row of a shard (term null) holds the doc_ids and
lengths. Document frequencies of the whole corpus come from the rows' counts alone.

Search: items go in blocks of a bounded number of terms, whose weights are broadcast. The postings of their terms are dealt
by shard. There an item's cursors are merged by a heap on the document number; the best documents are kept in a bounded
heap by score and then doc_id. Terms whose highest scores together can't reach that heap's least score are no longer
merged but only looked up (which drops no document that belongs in the result). The shards' best are merged at last.
"""

from __future__ import annotations

import heapq
import re
import uuid
from bisect import bisect_left
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import on_workers, released, shared_dir, stored

#: Terms with repeats after which a shard ends, and (item, term) pairs of a block of items.
SHARD_TOKENS, BLOCK_PAIRS = 1 << 21, 1 << 17
#: Numbers of the contract's score.
TOP, SCALE, TF, SOFT, FLAT, SLOPE = 10, 1_000_000_000, 1000, 8, 10, 90
#: Bytes of UTF-8 as they count: A-Z lower-cased, digits, letters and all beyond ASCII kept, others blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or re.match(rb"[0-9a-z]", bytes([b])) else 32 for b in range(256))
#: SQL for the same terms of a text.
TERMS = r"array_remove(split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), '')"

INDEX = "shard long, term string, df long, tokens long, data binary"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split(b" ") if text else []


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, places): numbers below 2^63 in groups of seven bits, least first, the top bit set on all but the last;
    places[k] is where number k begins, and one more place is the end."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for shift in range(7, 63, 7):
        size += (v >> np.uint64(shift)) > 0
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        part = (v[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[:-1][own] + k] = part | np.where(size[own] > k + 1, 128, 0).astype(np.uint64)
    return out, at


def unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(b < 128)
    if len(last) == len(b):  # all below 128
        return b.astype(np.int64)
    start = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), start)


def shard_rows(shard: int, doc_ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
    """The rows of one shard's index."""
    order = sorted(range(len(doc_ids)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0))
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(texts[k]) for k in order], np.int64)
    term = np.fromiter((number[t] for k in order for t in texts[k]), np.int64, int(lengths.sum()))
    key, times = np.unique(term * len(order) + np.repeat(np.arange(len(order)), lengths), return_counts=True)
    term, doc = key // len(order), key % len(order)
    cut = np.flatnonzero(np.diff(term, prepend=-1))
    gaps = np.diff(doc, prepend=0)
    gaps[cut] = doc[cut]
    (a, at), (b, bt) = packed(gaps), packed(times)
    ends = [*cut.tolist(), len(doc)]
    names = list(number)
    ids = np.array([doc_ids[k] or 0 for k in order], "<i8").tobytes() + np.array([doc_ids[k] is None for k in order], np.uint8).tobytes() + lengths.astype("<i8").tobytes()
    out = {"term": [None], "df": [int(np.count_nonzero(lengths))], "tokens": [int(lengths.sum())], "data": [ids]}
    a, b = a.tobytes(), b.tobytes()
    for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        out["term"].append(names[k].decode())
        out["df"].append(hi - lo)
        out["tokens"].append(0)
        out["data"].append(a[at[lo] : at[hi]] + b[bt[lo] : bt[hi]])
    return pd.DataFrame({"shard": shard, **out})


def build_index(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The index of docs (doc_id, text), written under path: rows (INDEX) of terms, and one of each shard's documents.

    Every row of docs is a document of its own, also one without a term, with a null doc_id (in order after all
    others) or with a doc_id that others have. A task's rows make one shard or several; a text is never cut. Tables
    without rows have no shards. Other columns are not read.
    """
    on_workers(docs.sparkSession)

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for pdf in batches:
            for i, none, text in zip(pdf["doc_id"], pdf["none"], pdf["text"], strict=True):
                own = [t for t in terms_of(text) if t]
                ids.append(None if none else int(i))
                texts.append(own)
                size += len(own)
                if size >= shard_tokens:
                    yield shard_rows((part << 32) + made, ids, texts)
                    made += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield shard_rows((part << 32) + made, ids, texts)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInPandas(released(run), INDEX), path)


class Cursor:
    """Postings of a term in a shard: numbers of documents in order, their scores without the term's weight, and the
    highest of them."""

    __slots__ = ("docs", "ratios", "most")

    def __init__(self, raw: bytes, df: int, soft: np.ndarray):
        both = unpacked(raw)
        docs, tf = np.cumsum(both[:df]), both[df:]
        ratios = SCALE * tf // (TF * tf + soft[docs])
        self.docs, self.ratios, self.most = docs.tolist(), ratios.tolist(), int(ratios.max())


def best_documents(cursors: list[tuple[int, Cursor]], top: int) -> list[tuple[int, int]]:
    """[(score, number)] of the top documents with a score above 0, best first, equal scores by number.

    cursors: (weight, postings) of an item's terms. merged: cursors in the heap, as their documents can still win;
    the others, of the lowest bounds, are looked up for a document while it can still win.
    """
    cursors = sorted((c for c in cursors if c[0] > 0), key=lambda c: -c[0] * c[1].most)
    bounds = [w * c.most for w, c in cursors]
    left = [0] * (len(bounds) + 1)  # the most that cursors from k on can add
    for k in reversed(range(len(bounds))):
        left[k] = left[k + 1] + bounds[k]
    merged, least = len(cursors), 0
    heap = [(c.docs[0], k, 0) for k, (_, c) in enumerate(cursors)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []  # (score, -number), the worst on top
    while heap:
        doc, k, at = heap[0]
        score = 0
        while doc == heap[0][0]:
            _, k, at = heap[0]
            weight, c = cursors[k]
            score += weight * c.ratios[at]
            if k < merged and at + 1 < len(c.docs):
                heapq.heapreplace(heap, (c.docs[at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
                if not heap:
                    break
        for k in range(merged, len(cursors)):
            if score + left[k] <= least:
                break
            weight, c = cursors[k]
            at = bisect_left(c.docs, doc)
            if at < len(c.docs) and c.docs[at] == doc:
                score += weight * c.ratios[at]
        else:
            # Documents come in order, so one with an equal score is worse than those that are kept.
            if score > least:
                if len(best) < top:
                    heapq.heappush(best, (score, -doc))
                else:
                    heapq.heapreplace(best, (score, -doc))
                if len(best) == top:
                    least = best[0][0]
                    now = merged
                    while now > 0 and left[now - 1] <= least:
                        now -= 1
                    if now < merged:
                        heap = [x for x in heap if x[1] < now]
                        heapq.heapify(heap)
                        merged = now
    return [(score, -n) for score, n in sorted(best, reverse=True)]


def search(index: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item (item_id, text).

    An item's terms count once each. Every row of items is an item of its own; one without a known term, or with a
    null text, has no rows. Equal scores are ordered by doc_id, a null one last. An empty index or no items give none.
    """
    spark = index.sparkSession
    on_workers(spark)
    work = shared_dir(spark, "search")
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.array_distinct(F.expr(TERMS.replace("text", "CAST(text AS string)"))).alias("terms"))
    asked = stored(asked, f"{work}/items")
    named = asked.select("item", "item_id")
    pairs = asked.select("item", F.explode("terms").alias("term"))
    sizes = index.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("l")).first()
    n, total = int(sizes["n"]), int(sizes["l"])
    df = index.where("term IS NOT NULL").join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighed = pairs.join(df, "term").select("item", "term", weight.cast("long").alias("w")).where("w > 0")
    weighed = stored(weighed, f"{work}/weights")
    # Items in blocks, so that what is broadcast has at most block_pairs pairs, or one item's.
    todo, found = [(weighed, 0)], None
    while todo:
        own, level = todo.pop()
        if own.count() > block_pairs and own.select("item").distinct().count() > 1:
            todo += [(own.where(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(2)) == k), level + 1) for k in (0, 1)]
            continue
        part = stored(_block(index, own, n, total, top), f"{work}/found-{uuid.uuid4().hex}")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "shard", "number")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def _block(index: DataFrame, weighed: DataFrame, n: int, total: int, top: int) -> DataFrame:
    """The top of each shard for one block of items."""
    users = weighed.groupBy("term").agg(F.collect_list("item").alias("items"), F.collect_list("w").alias("ws"))
    none = F.lit(None)
    heads = index.where("term IS NULL").select("shard", "df", "data", none.cast("array<long>").alias("items"), none.cast("array<long>").alias("ws"))
    rows = index.where("term IS NOT NULL").join(F.broadcast(users), "term").select("shard", "df", "data", "items", "ws").unionByName(heads)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["items"].isna()
        raw = pdf["data"][head].iloc[0]
        docs = len(raw) // 17
        ids, none, lengths = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs), np.frombuffer(raw, "<i8", docs, 9 * docs)
        soft = SOFT * (FLAT + SLOPE * lengths * n // max(total, 1))
        of: defaultdict[int, list] = defaultdict(list)
        for df, data, items, ws in pdf[~head][["df", "data", "items", "ws"]].itertuples(index=False, name=None):
            c = Cursor(data, df, soft)
            for item, w in zip(items.tolist(), ws.tolist(), strict=True):
                of[item].append((w, c))
        out = [(item, score, k) for item, cursors in of.items() for score, k in best_documents(cursors, top)]
        got = pd.DataFrame(out, columns=["item", "score", "number"], dtype="int64")
        at = got["number"].to_numpy()
        got["doc_id"] = pd.array(ids[at], "Int64")
        got.loc[none[at] > 0, "doc_id"] = pd.NA
        got["shard"] = pdf["shard"].iloc[0]
        return got

    return rows.groupBy("shard").applyInPandas(run, "item long, score long, number long, doc_id long, shard long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    return search(build_index(docs, shared_dir(docs.sparkSession, "index")), items, top)
