"""Hard negatives of anchors among embeddings: exact integer products behind bounds in rotated coordinates.

Vectors are rounded to integers. Their second moments (sums over all rows) give an orthogonal rotation whose
leading coordinates hold most of a product. Rows are cut into tiles of TILE rows; anchors are taken in rounds of ROUND,
which are sent to all tasks. In a task products over the leading coordinates are accumulated for a tile and all anchors;
what is left is at most the product of the residual norms, plus slack for rounding. Pairs whose upper bound is below
what an anchor already has are discarded, after LEADING coordinates and again with each part more; the survivors get
their integer product. A first pass finds each anchor's positives, a second one the negatives in their ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import on_workers, released, shared_dir, stored

#: Rows of a tile, anchors of a round, and leading coordinates before each test for discarding (as parts of all).
TILE, ROUND, LEADING = 4096, 8192, (0.125, 0.25, 0.5)
#: Factor of the components; size of an integer component up to which rows take part.
SCALE, LARGEST = 256, 1 << 24
#: Pairs that are held at once.
PAIRS = 1 << 18

TILES = "ids binary, rows binary, labels binary, vectors binary, dims int"


def integers(embeddings: DataFrame, anchor: Column, label: Column) -> DataFrame:
    """(vec_id, label, v array<long>, anchor, row) of the rows that take part; row is a number of their own."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(float(LARGEST) / SCALE))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(F.forall("embedding", finite))
    v = F.transform("embedding", lambda c: F.floor(c * SCALE).cast("int"))
    return own.select("vec_id", label.alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"))


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal columns, those of the largest second moments first; dims x dims sums, made by aggregation."""
    if not dims:
        return np.zeros((0, 0))

    def run(batches):
        out = np.zeros((dims, dims))
        for pdf in batches:
            x = padded(pdf["v"], dims).astype(np.float64)
            out += x.T @ x
        i, j = np.triu_indices(dims)
        yield pd.DataFrame({"i": i, "j": j, "x": out[i, j]})

    sums = rows.select("v").mapInPandas(released(run), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # dims * (dims + 1) / 2 rows
    moments = np.zeros((dims, dims))
    moments[sums["i"], sums["j"]] = moments[sums["j"], sums["i"]] = sums["x"]
    return np.linalg.eigh(moments)[1][:, ::-1]


def padded(vectors, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dims), np.int32)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def tiled(rows: DataFrame, dims: int, path: str, tile: int) -> DataFrame:
    """Rows of up to tile vectors, packed where they lie, in the order of labels."""

    def pack(parts: list[pd.DataFrame]) -> pd.DataFrame:
        one = pd.concat(parts).sort_values(["label", "vec_id", "row"])
        raw = lambda c: one[c].to_numpy().astype("<i8").tobytes()
        return pd.DataFrame({"ids": [raw("vec_id")], "rows": [raw("row")], "labels": [raw("label")], "vectors": [padded(one["v"], dims).astype("<i4").tobytes()], "dims": [dims]})

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            for at in range(0, len(pdf), tile):
                held.append(pdf.iloc[at : at + tile])
                size += len(held[-1])
                if size >= tile:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return stored(rows.select("vec_id", "label", "v", "row").mapInPandas(released(run), TILES), path)


class Block:
    """Vectors of a tile or of a round of anchors: as integers, rotated, and the norms of what follows each part."""

    def __init__(self, ids, rows, labels, vectors: np.ndarray, turn: np.ndarray, parts: list[int]):
        self.ids, self.rows, self.labels, self.vectors = ids, rows, labels, vectors
        exact = vectors.astype(np.float64) @ turn
        self.turned = exact.astype(np.float32)
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.rest = [np.sqrt((exact[:, p:] ** 2).sum(axis=1)) for p in parts]

    @classmethod
    def of(cls, tiles: list, turn: np.ndarray, parts: list[int]) -> Block:
        ids, rows, labels = (np.concatenate([np.frombuffer(t[k], "<i8") for t in tiles]) for k in ("ids", "rows", "labels"))
        vectors = np.concatenate([np.frombuffer(t["vectors"], "<i4") for t in tiles])
        return cls(ids, rows, labels, vectors.reshape(len(ids), tiles[0]["dims"]), turn, parts)


def candidates(anchors: Block, who: np.ndarray, tile: Block, cols: slice, floor: np.ndarray, ceiling: np.ndarray, parts: list[int], slack: float):
    """(anchor, place) pairs of a range of the tile whose product may lie between floor and ceiling of the anchor.

    slack: part of the product of both norms by which products in rounded coordinates may be wrong.
    """
    a, b = anchors.turned[who], tile.turned[cols]
    wrong = slack * np.outer(anchors.norms[who], tile.norms[cols]).astype(np.float32) + np.float32(1)
    now, alive = a[:, : parts[0]] @ b[:, : parts[0]].T, None
    lo, hi = (np.clip(x[who], -3e38, 3e38).astype(np.float32) for x in (floor, ceiling))
    for k, p in enumerate(parts):
        if alive is None:
            if k:
                now += a[:, parts[k - 1] : p] @ b[:, parts[k - 1] : p].T
            room = np.outer(anchors.rest[k][who], tile.rest[k][cols]).astype(np.float32) * np.float32(1.0001) + wrong
            ok = (now + room >= lo[:, None]) & (now - room <= hi[:, None])
            if p == parts[-1] or np.count_nonzero(ok) * 8 < ok.size:
                alive = np.nonzero(ok)
                value = now[alive]
        else:
            i, j = alive
            value = value + np.einsum("ij,ij->i", a[i, parts[k - 1] : p], b[j, parts[k - 1] : p])
            room = (anchors.rest[k][who][i] * tile.rest[k][cols][j]).astype(np.float32) * np.float32(1.0001) + wrong[i, j]
            ok = (value + room >= lo[i]) & (value - room <= hi[i])
            alive, value = (i[ok], j[ok]), value[ok]
    i, j = alive
    return who[i], j + cols.start


def products(anchors: Block, tile: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", anchors.vectors[i].astype(np.int64), tile.vectors[j].astype(np.int64))


class Best:
    """The top products so far, by anchor and range of products (lo, hi: one row for each anchor)."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, lo: np.ndarray, hi: np.ndarray, top: int):
        self.lo, self.hi, self.top = lo, hi, top
        self.score = np.full((*lo.shape, top), self.NONE)
        self.ids, self.rows = np.zeros_like(self.score), np.zeros_like(self.score)
        self.full = lo.copy()  # least product that can still come in
        self.floor, self.ceiling = np.empty(len(lo)), np.empty(len(lo))
        self._ends(np.arange(len(lo)))

    def _ends(self, who: np.ndarray) -> None:
        open_ = self.lo[who] <= self.hi[who]
        self.floor[who] = np.where(open_, self.full[who].astype(float), np.inf).min(axis=1, initial=np.inf)
        self.ceiling[who] = np.where(open_, self.hi[who].astype(float), -np.inf).max(axis=1, initial=-np.inf)

    def entries(self, who: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, range, score, id, row) of what some anchors have."""
        k, at, n = np.nonzero(self.score[who] != self.NONE)
        return who[k], at, self.score[who[k], at, n], self.ids[who[k], at, n], self.rows[who[k], at, n]

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        of, at = np.nonzero((score[:, None] >= self.full[anchor]) & (score[:, None] <= self.hi[anchor]))
        who = np.unique(anchor[of])
        anchor, at, score, ids, rows = (np.concatenate(x) for x in zip(self.entries(who), (anchor[of], at, score[of], ids[of], rows[of]), strict=True))
        key = anchor * self.lo.shape[1] + at
        order = np.lexsort((rows, ids, -score, key))
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
        order, rank = order[rank < self.top], rank[rank < self.top]
        place = anchor[order], at[order], rank
        self.score[place], self.ids[place], self.rows[place] = score[order], ids[order], rows[order]
        worst = self.score[who, :, -1]
        self.full[who] = np.where(worst == self.NONE, self.lo[who], worst)
        self._ends(who)


def _pass(tiles: DataFrame, anchors: Block, turn: np.ndarray, parts: list[int], lo: np.ndarray, hi: np.ndarray, top: int, same: bool) -> DataFrame:
    """(anchor, at, score, id, row): the top of each task for each anchor (its place in the round) and range."""
    dims = turn.shape[0]
    slack = 2.0**-23 * (dims + 8)
    sent = tiles.sparkSession.sparkContext.broadcast((anchors, turn, lo, hi))  # at most ROUND anchors

    def run(batches):
        anchors, turn, lo, hi = sent.value
        best = Best(lo, hi, top)
        for pdf in batches:
            for t in pdf.to_dict("records"):
                tile = Block.of([t], turn, parts)
                cut = np.flatnonzero(np.diff(tile.labels, prepend=tile.labels[0] - 1))
                for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(tile.labels)], strict=True):
                    every = np.flatnonzero((anchors.labels == tile.labels[a]) == same)
                    every = every[best.floor[every] <= best.ceiling[every]]
                    step = max(1, PAIRS // (z - a))
                    for who in (every[k : k + step] for k in range(0, len(every), step)):
                        i, j = candidates(anchors, who, tile, slice(a, z), best.floor, best.ceiling, parts, slack)
                        other = anchors.rows[i] != tile.rows[j]
                        i, j = i[other], j[other]
                        if len(i):
                            best.add(i, products(anchors, tile, i, j), tile.ids[j], tile.rows[j])
        yield pd.DataFrame(dict(zip(("anchor", "at", "score", "id", "row"), best.entries(np.arange(len(lo))), strict=True)))

    return tiles.mapInPandas(released(run), "anchor long, at long, score long, id long, row long")


def _rounds(asked: DataFrame, round_: int) -> Iterator[list]:
    """Packed anchors, one round at a time: tiles of less than twice round_ anchors."""
    held, size = [], 0
    for t in asked.toLocalIterator(prefetchPartitions=False):
        held.append(t)
        size += len(t["ids"]) // 8
        if size >= round_:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merged(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hard_negatives(embeddings: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tile: int = TILE, round_: int = ROUND) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    embeddings: (vec_id, embedding, label). Scores are products of the components times 256, rounded down. Rows for
    which the condition anchor holds are anchors; an anchor's positives are the positives other rows of its label
    (label: an expression of vec_id and label, label itself if not given) with the highest scores, and for each of them
    the negatives rows of other labels with the highest scores among those from low to high per cent of its score.
    Equal scores are ordered by vec_id. Rows with a null id, label or vector, a null or non-finite component, or one
    whose integer is beyond LARGEST take no part. Shorter vectors end in zeros, an empty one is all zeros. Rows that
    repeat an id are rows of their own, so each is another's partner, and repeated anchors have repeated results. An
    empty table, no anchors, or no partners give no rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    on_workers(spark)
    work = shared_dir(spark, "negatives")
    rows = stored(integers(embeddings, anchor, F.col("label") if label is None else label), f"{work}/rows")
    dims = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()["d"]
    turn = rotation(rows, dims)
    parts = sorted({min(dims, max(1, round(dims * p))) for p in (*LEADING, 1)}) if dims else [0]
    tiles = tiled(rows, dims, f"{work}/tiles", tile)
    asked = tiled(rows.where("anchor"), dims, f"{work}/anchors", round_)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for k, tiles_ in enumerate(_rounds(asked, round_)):
        anchors = Block.of(tiles_, turn, parts)
        n = len(anchors.ids)
        wide = (np.full((n, 1), -(2**62)), np.full((n, 1), 2**62))
        near = _merged(stored(_pass(tiles, anchors, turn, parts, *wide, positives, True), f"{work}/near-{k}"), positives)
        near = stored(near.select("anchor", (F.col("rank") - 1).alias("at"), "score", "id"), f"{work}/positives-{k}")
        own = near.toPandas()  # at most round_ * positives rows
        lo, hi = np.full((n, positives), 1), np.full((n, positives), 0)
        place = own["anchor"].to_numpy(), own["at"].to_numpy()
        lo[place], hi[place] = -((-low * own["score"]) // 100), high * own["score"] // 100
        far = _merged(stored(_pass(tiles, anchors, turn, parts, lo, hi, negatives, False), f"{work}/far-{k}"), negatives)
        far = far.select("anchor", "at", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
        ids = spark.createDataFrame(pd.DataFrame({"anchor": np.arange(n), "anchor_id": anchors.ids}))
        both = near.select("anchor", "at", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")).join(far, ["anchor", "at"]).join(F.broadcast(ids), "anchor")
        out = out.unionByName(stored(both.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"), f"{work}/out-{k}"))
    return out
