"""Near-duplicate documents by MinHash with tensored banding.

Two small collections, A and B, of M half keys each are made from M * T min-hashes each. The
tables of the scheme are all pairs (A_i, B_j): M * M tables from 2 * M * T min-hashes, about the
square root of what M * M separate tables would cost. Two sets of similarity s miss every table
with a chance of at most 2 * (1 - s^T)^M: 5e-5 at 0.8 and 2e-7 at 0.9. Documents of the same set
are one node from the start.

Candidates are confirmed on full shingle sets, without forming all pairs of a large bucket:

1. In each bucket the most central member (most rows met in all buckets) leads, and everyone is
   compared with it. TURNS times over, with those that remain.
2. What remains in buckets of at most SPLIT rows is compared pair by pair.
3. Members of larger buckets that are not in their leader's component yet are open. A prefix filter
   finds their partners among all members of such buckets: shingles are ordered rarest first, and
   two sets of enough overlap share one in their first few. Prefixes are cut for each pair of size
   classes, so those of texts with enough words of their own hold nothing that others have. This
   step is exact; so no link between two texts of a bucket is lost and nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, mix, on_workers, prefix_hash, released, shared_dir, span_hash, stored

#: Largest bucket that is compared pair by pair, and how often leaders are elected before that.
SPLIT, TURNS = 24, 3
#: Digests of more than this part of all rows are hot.
HOT = 1000
#: Ratio of the bounds of neighbouring size classes, and shingles of leaders that a worker remembers.
STEP, KEPT = 1.03, 1 << 20


def multipliers(collection: int, m: int, t: int) -> np.ndarray:
    """Odd multipliers, one per min-hash of a collection."""
    return np.random.Generator(np.random.PCG64(collection + 7)).integers(1, 2**31, m * t, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased, words are runs without ASCII white space. A shorter text is one shingle;
    null or no words: empty.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(b" ".join(parts), np.uint8)
    ends = np.append(np.flatnonzero(buf == 32), len(buf))
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    return np.unique(span_hash(prefix_hash(buf), starts[: len(starts) - k + 1], ends[k - 1 :]))


def half_keys(h: np.ndarray, a: np.ndarray, m: int, t: int) -> np.ndarray:
    """The M half keys of a collection with multipliers a, for one non-empty set."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(m * t, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(least, (a[:, None] * low[None, i : i + 4096]).min(axis=1), out=least)
    key = np.arange(1, m + 1, dtype=np.uint64)
    for c in least.reshape(m, t).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return key.view(np.int64)


def _signatures(words: int, m: int, t: int):
    @released
    def run(batches):
        left, right = multipliers(0, m, t), multipliers(1, m, t)
        for pdf in batches:
            out = []
            for i, v, text in zip(pdf["doc_id"], pdf["version"], pdf["text"], strict=True):
                h = shingle_set(text, words)
                a, b = (half_keys(h, left, m, t), half_keys(h, right, m, t)) if len(h) else (None, None)
                out.append((i, v, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None, a, b))
            yield pd.DataFrame(out, columns=["doc_id", "version", "n_shingles", "digest", "a", "b"])

    return run


def _tokens(words: int):
    @released
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "tokens": [shingle_set(x, words).view(np.int64) for x in pdf["text"]]})

    return run


def size_class(n: int) -> int:
    c = int(math.log(n) / math.log(STEP))
    while least_size(c + 1) <= n:
        c += 1
    while least_size(c) > n:
        c -= 1
    return c


def least_size(c: int) -> int:
    return math.ceil(STEP**c - 1e-9)


def _prefixes(percent: int):
    """Rows (node, of, open, token, small, large, role) of each node's prefixes; role 0: it is the smaller.

    Tokens that can't bring an open node together with one of another component have no rows.
    """

    @released
    def run(batches):
        for pdf in batches:
            out = []
            for node, of, open_, n, order in zip(pdf["node"], pdf["of"], pdf["open"], pdf["n"], pdf["order"], strict=True):
                own = size_class(n)
                for role in (0, 1):
                    c = own
                    while 100 * (least_size(c) if role == 0 else n) * percent <= 10000 * (n if role == 0 else least_size(c + 1) - 1) and c >= 0:
                        need = -(-percent * (n + least_size(c)) // (100 + percent))
                        for x in order[: max(0, n - need + 1)]:
                            if x["useful"]:
                                out.append((node, of, open_, x["token"], own if role == 0 else c, c if role == 0 else own, role))
                        c += 1 if role == 0 else -1
            yield pd.DataFrame(out, columns=["node", "of", "open", "token", "small", "large", "role"])

    return run


def _compare(words: int):
    @released
    def run(batches):
        kept: dict = {}
        held = 0

        def get(i, text):
            nonlocal held
            if i not in kept:
                if held > KEPT:
                    kept.clear()
                    held = 0
                kept[i] = shingle_set(text, words)
                held += len(kept[i])
            return kept[i]

        for pdf in batches:
            both = []
            for i, text, other in zip(pdf["leader"], pdf["leader_text"], pdf["node_text"], strict=True):
                x, y = get(i, text), shingle_set(other, words)
                n = len(np.intersect1d(x, y, assume_unique=True))
                both.append((n, len(x) + len(y) - n))
            n = np.array(both, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"leader": pdf["leader"], "node": pdf["node"], "common": n[:, 0], "total": n[:, 1]})

    return run


def crowded(met: DataFrame) -> DataFrame:
    """(bucket) of those with an open row and two nodes besides the leader; other is null in the leader's rows."""
    return met.groupBy("bucket").agg(F.max("open").alias("any"), F.min("other").alias("lo"), F.max("other").alias("hi")).where("any AND lo < hi").select("bucket")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, m: int = 16, t: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, version, stays) of every row.

    Documents link if 100 * |common shingles| >= percent * |all shingles|; component_id is the
    smallest doc_id reachable over links. kept: the row has that doc_id; stays: it is the one row of its component
    that does. Null or wordless texts have the empty set and link with nothing. Rows of one doc_id are told apart by their
    texts (version): each links for itself, and its component has nothing to do with the others'. Only doc_id and text are used,
    so other columns may have any names. A row without a doc_id links with nothing, has no component_id, and is kept and stays.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    on_workers(spark)
    work = shared_dir(spark, "near-dup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("version", version(F.col("text")))
    each = docs.mapInPandas(_signatures(words, m, t), "doc_id long, version binary, n_shingles long, digest binary, a array<long>, b array<long>")
    # The number of a row is made once and written.
    sig = stored(each.withColumn("row", F.monotonically_increasing_id()), f"{work}/signatures")

    # A node is a set of shingles, numbered by its first row; doc_ids only come in again at the end.
    first = sig.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.min(F.struct("doc_id", "row")).alias("least"))
    first = stored(first, f"{work}/classes")
    reps = sig.withColumnRenamed("row", "node").join(first.select("node"), "node", "left_semi").select("node", "doc_id", "version", "a", "b")

    half = stored(reps.select("node", F.posexplode("a").alias("i", "key")), f"{work}/half")
    shared = half.groupBy("key").agg(F.count_if(F.lit(True)).alias("n")).where("n > 1").select("key")
    met = half.join(shared, "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys"))
    buckets = met.join(reps.select("node", "b"), "node").select("node", F.explode("keys").alias("key"), "b")
    buckets = stored(buckets.select("node", "key", F.posexplode("b").alias("j", "other")).select("node", "key", F.xxhash64("key", "j", "other").alias("bucket")), f"{work}/buckets")
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    active = stored(buckets.join(full, "bucket", "left_semi"), f"{work}/active-0")

    needed = reps.select("node", "doc_id", "version").join(active.select("node").distinct(), "node", "left_semi")
    texts = docs.join(needed, ["doc_id", "version"]).dropDuplicates(["node"])
    texts = stored(texts.select("node", "text"), f"{work}/texts")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        wide = pairs.join(texts.withColumnRenamed("text", "node_text"), "node").join(texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text")), "leader")
        return stored(wide.mapInPandas(_compare(words), "leader long, node long, common long, total long"), f"{work}/{name}")

    links = f"100 * common >= {percent} * total"
    turn, known, led = 0, None, None

    def unmet(pairs: DataFrame) -> DataFrame:
        """Without those compared before, either way round."""
        both = known.select("leader", "node").unionByName(known.selectExpr("node AS leader", "leader AS node"))
        return pairs.join(both, ["leader", "node"], "left_anti")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        compared(pairs, f"pairs/turn={name}")
        return spark.read.parquet(f"{work}/pairs").select("leader", "node", "common", "total")

    for turn in range(TURNS):
        size = active.groupBy("bucket").agg(F.count("*").alias("n"))
        weight = active.join(size, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))
        lead = active.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("l"))
        led = stored(active.join(lead.select("bucket", F.col("l.node").alias("leader")), "bucket"), f"{work}/led-{turn}")
        pairs = led.where("node <> leader").select("leader", "node").distinct()
        known = confirmed(unmet(pairs) if turn else pairs, str(turn))
        # Those not linked go on; buckets of one half key A_i and one leader become one, so a row isn't kept for each B_j.
        left = led.where("node <> leader").select("leader", "node", "key").distinct()
        left = left.join(known.where(f"NOT ({links})"), ["leader", "node"], "left_semi").select("node", "key", F.xxhash64("key", "leader").alias("bucket"))
        many = left.groupBy("bucket").agg(F.count("*").alias("n"))
        active = stored(left.join(many.where("n > 1"), "bucket").select("node", "key", "bucket", "n"), f"{work}/active-{turn + 1}")
        few = active.where(f"n <= {SPLIT}")
        few = few.select(F.col("node").alias("leader"), "bucket").join(few.select("node", "bucket"), "bucket").where("leader < node").select("leader", "node").distinct()
        known = confirmed(unmet(few), f"{turn}-few")
        open_rows = left.join(many.where(f"n > {SPLIT}"), "bucket", "left_semi").select("node", "key", "bucket")
        active = stored(open_rows, f"{work}/active-{turn + 1}-large")
        if active.isEmpty():
            break

    label = components(known.where(links).selectExpr("leader AS u", "node AS v"), f"{work}/cc-0")

    # Rows whose node isn't in the component of a leader of its bucket, whatever the bucket's size.
    at = [spark.read.parquet(f"{work}/led-{i}").select("bucket", "node", "leader") for i in range(turn + 1)]
    met = reduce(DataFrame.unionByName, at)
    met = met.join(label.select("node", F.col("label").alias("of")), "node", "left").join(label.select(F.col("node").alias("leader"), F.col("label").alias("at")), "leader", "left")
    met = stored(met.select("bucket", "node", F.expr("nullif(node, leader)").alias("other"), F.coalesce("of", "node").alias("of"), (F.coalesce("of", "node") != F.coalesce("at", "leader")).alias("open")), f"{work}/met")
    there = stored(met.join(crowded(met), "bucket", "left_semi").groupBy("node").agg(F.max("open").alias("open"), F.first("of").alias("of")), f"{work}/there")
    tokens = stored(texts.join(there, "node", "left_semi").mapInPandas(_tokens(words), "node long, tokens array<long>"), f"{work}/tokens")
    each = tokens.join(there, "node").select("node", "of", "open", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    useful = F.max("open") & (F.min("of") != F.max("of"))
    df = each.groupBy("token").agg(F.count("*").alias("df"), useful.alias("useful"))
    order = each.join(df, "token").groupBy("node", "of", "open", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token", "useful"))).alias("order"))
    rows = stored(order.mapInPandas(_prefixes(percent), "node long, of long, open boolean, token long, small int, large int, role int"), f"{work}/prefixes")
    mine = rows.where("open").selectExpr("node AS leader", "of AS mine", "token", "small", "large", "1 - role AS role")
    rest = mine.join(rows.select("node", "of", "token", "small", "large", "role"), ["token", "small", "large", "role"]).where("of <> mine")
    rest = rest.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")).distinct()
    known = confirmed(unmet(rest), "rest")
    label = components(known.where(links).selectExpr("leader AS u", "node AS v"), f"{work}/cc-1")

    of = stored(first.join(label, "node", "left").select("digest", "least", F.coalesce("label", "node").alias("component")), f"{work}/of")
    least = of.groupBy("component").agg(F.min("least").alias("least"))
    of = of.select("digest", "component").join(least, "component").select("digest", "least")
    # A digest that many rows have meets them by a broadcast; there are less than HOT such digests.
    sized = sig.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"))
    hot = sized.where(F.col("n") * HOT > sig.count()).select("digest")
    hot = stored(of.join(hot, "digest"), f"{work}/hot")
    own = F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")
    rows = sig.select("doc_id", "version", "n_shingles", "row", own)
    out = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(of, "digest", "left"))
    kept = F.col("component_id").eqNullSafe(F.col("doc_id"))
    out = out.withColumn("component_id", F.coalesce("least.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "version", (kept & F.coalesce(F.col("least.row") == F.col("row"), F.lit(True))).alias("stays"))


def version(text: Column) -> Column:
    """What tells the texts of one doc_id apart; null for a null text."""
    return F.unhex(F.md5(text))
