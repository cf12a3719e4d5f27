"""Best-fit packing of token pieces into sequences by bin completion.

Lengths are at most the sequence's, so how often each occurs says all that packing needs: one table
of at most 1024 rows, however many documents there are. A plan is a list of patterns and how often each is used. Bin completion takes the
largest remaining length and its undominated fillings: those of least waste, found exactly over all
subsets that the counts allow, one for each of several preferences among equals (large pieces, or lengths of which much is left), without those that
another one dominates. It follows the best one as often as the counts allow, branches to the others, and gives a branch up when its
sequences and the bound on the rest reach the incumbent's. The incumbent is best-fit decreasing at first.
Until the plan reaches the bound, parts of it (some sequences with waste, some without) are taken out and completed anew in the
same way. Pieces find their sequence by their rank among those of their length.
"""

from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import on_workers, shared_dir, stored
from .tokens import END_ID, encoded, encoder

#: Nodes of a search after its first plan, parts of a plan that are completed anew at most, and the largest number of sequences of a
#: kind that are taken for a part.
NODES, ROUNDS, KINDS = 12, 3000, 80
#: Preferences among fillings of equal waste: pieces of length k, of which n are left, go by n * k ** power; the last one by k.
POWERS = (1.0, 1.5, 2.0, 3.0, None)


def waste_bound(counts: dict[int, int], size: int) -> int:
    """Martello and Toth's bound: large pieces need sequences of their own, others fill what is left."""
    k = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in k.tolist()], np.int64)
    many, tokens = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * k)))
    half = int(np.searchsorted(k, size // 2, side="right"))
    alpha = np.concatenate(([0], k[:half]))
    big = np.searchsorted(k, size - alpha, side="right")
    two = many[big] - many[half]
    room = size * two - (tokens[big] - tokens[half])
    three = tokens[half] - tokens[np.minimum(np.searchsorted(k, alpha), half)]
    bound = many[-1] - many[big] + two + np.maximum(0, -(-(three - room) // size))
    return max(int(-(-tokens[-1] // size)), int(bound.max()))


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing as (times, lengths in a sequence), over the counts of lengths.

    A sequence that takes a piece is then the one of least room that holds the next piece of that length,
    as long as it fits; so sequences of the same content fill alike and needn't be told apart.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for k in sorted(counts, reverse=True):
        n = counts[k]
        for room in [*sorted(r for r in open_ if r >= k), size]:
            if not n:
                break
            per = room // k
            kinds = open_.pop(room) if room < size else [(-(-n // per), ())]
            for times, held in kinds:
                full = min(times, n // per)
                rest = min(n - full * per, per) if full < times else 0
                n -= full * per + rest
                for t, m in ((full, per), (1 if rest else 0, rest), (times - full - (rest > 0), 0)):
                    if t:
                        open_.setdefault(room - m * k, []).append((t, held + (k,) * m))
    return [kind for kinds in open_.values() for kind in kinds]


def holds(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of small fit into those of big, as bins."""
    room = list(big)

    def place(i: int) -> bool:
        if i == len(small):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= small[i] and r not in tried:
                tried.add(r)
                room[j] -= small[i]
                if place(i + 1):
                    return True
                room[j] += small[i]
        return False

    return place(0)


def filling(order: list[int], counts: dict[int, int], room: int) -> tuple[int, ...]:
    """Pieces of most tokens within room, later ones in order preferred. Sums that can be made are the bits of a number."""
    sums, before, use, mask = 1, [], [], (1 << (room + 1)) - 1
    for k in order:
        m = min(counts[k], room // k)
        if m <= 0:
            continue
        before.append(sums)
        use.append(k)
        part = 1
        while m:
            t = min(part, m)
            sums |= sums << (t * k)
            m -= t
            part *= 2
        sums &= mask
    left, out = sums.bit_length() - 1, []
    for k, sums in zip(reversed(use), reversed(before), strict=True):
        m = min(counts[k], left // k)
        while not sums >> (left - m * k) & 1:
            m -= 1
        out += [k] * m
        left -= m * k
    return tuple(sorted(out, reverse=True))


def fillings(counts: dict[int, int], room: int, powers: tuple) -> list[tuple[int, ...]]:
    """Undominated fillings of room of least waste, the one of the first preference first."""
    sizes = [k for k, n in counts.items() if n and k <= room]
    found: list[tuple[int, ...]] = []
    for power in powers:
        f = filling(sorted(sizes, key=(lambda k: k) if power is None else lambda k: (counts[k] * k**power, k)), counts, room)
        if f not in found and not any(len(g) < len(f) and holds(g, f) for g in found):
            found.append(f)
    return found


def complete(counts: dict[int, int], size: int, powers: tuple, best_n: int, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]] | None:
    """A plan of at most best_n sequences by bin completion, the best that is found; None if there is none.

    The first plan is followed to its end unless the bound forbids; nodes: how many more are looked at.
    """
    bound = waste_bound(counts, size)
    best, left, first = None, nodes, True
    stack: list = [(dict(counts), 0, None)]
    plan: list[tuple[int, tuple[int, ...]]] = []
    while stack:
        now, used, step = stack.pop()
        if now is None:  # this branch is done
            plan.pop()
            continue
        if step:
            plan.append(step)
            stack.append((None, 0, None))
        if not now:
            first = False
            if used < best_n or best is None and used <= best_n:
                best, best_n = list(plan), used
            if best_n <= bound:
                break
            continue
        limit = best_n - (best is not None)
        if used + -(-sum(k * n for k, n in now.items()) // size) > limit or not first and (left <= 0 or used + waste_bound(now, size) > limit):
            continue
        left -= not first
        top = max(now)
        now[top] -= 1
        # Other branches are kept for the last nodes only: a long plan would hold thousands of tables.
        ways = fillings(now, size - top, powers if len(now) <= 2 * nodes else powers[:1])
        now[top] += 1
        for f in reversed(ways):
            need: dict[int, int] = {top: 1}
            for k in f:
                need[k] = need.get(k, 0) + 1
            times = min(now[k] // n for k, n in need.items())
            after = {k: m for k, n in now.items() if (m := n - times * need.get(k, 0))}
            stack.append((after, used + times, (times, (top, *f))))
    return best


def pack(counts: dict[int, int], size: int, rounds: int = ROUNDS, seed: int = 1) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths in a sequence) that use up counts (length -> pieces) in few sequences; the same in every run."""
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    bound = waste_bound(counts, size)
    plan = best_fit(counts, size)
    total = lambda p: sum(times for times, _ in p)
    for k in range(len(POWERS)):
        if total(plan) > bound:
            plan = complete(counts, size, POWERS[k:] + POWERS[:k], total(plan) - 1) or plan
    now: dict[tuple[int, ...], int] = {}
    for times, f in plan:
        f = tuple(sorted(f, reverse=True))
        now[f] = now.get(f, 0) + times
    n, rng = total(plan), random.Random(seed)
    waste = lambda p: sum(times * (size - sum(f)) ** 2 for f, times in p)
    for _ in range(rounds):
        if n <= bound:
            break
        part: dict[tuple[int, ...], int] = {}
        for kinds in ([f for f in now if sum(f) < size], [f for f in now if sum(f) == size]):
            for f in rng.sample(kinds, min(len(kinds), rng.randint(0, KINDS))):
                part[f] = min(now[f], rng.choice((1, 2, 5, 20)))
        own: dict[int, int] = {}
        for f, times in part.items():
            for k in f:
                own[k] = own.get(k, 0) + times
        if not own:
            continue
        powers = rng.sample(POWERS, len(POWERS))
        got = complete(own, size, tuple(powers), sum(part.values()))
        # Of plans of one size, those whose waste stands together leave room for another piece.
        if got is None or total(got) == sum(part.values()) and waste((f, t) for t, f in got) < waste(part.items()):
            continue
        n += total(got) - sum(part.values())
        for f, times in part.items():
            now[f] -= times
            if not now[f]:
                del now[f]
        for times, f in got:
            f = tuple(sorted(f, reverse=True))
            now[f] = now.get(f, 0) + times
    return [(times, f) for f, times in now.items()]


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document is its ids and the end id; a longer one than size is cut, its first piece taking the
    remainder. Null text: the end id only. Rows without a doc_id are left out; repeated rows are
    packed each. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    work = shared_dir(spark, "packing")

    def cut(batches):
        encode, end = encoder(tokenizer), array("I", [end_id]).tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for pdf in batches:
            out = []
            for i, ids in zip(pdf["doc_id"], encoded(pdf["text"], encode), strict=True):
                raw = ids + end
                n = len(raw) // 4
                to = n % size or size
                start, piece = 0, 0
                while start < n:
                    k = to - start
                    out.append((i, piece, start, k, zlib.crc32(raw[4 * start : 4 * to]), part, seen[k]))
                    seen[k] += 1
                    start, to, piece = to, to + size, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    pieces = stored(rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"), f"{work}/pieces")
    each = stored(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")), f"{work}/counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots, base, rank = [], 0, {}
    for times, lengths in pack(counts, size):
        at = 0
        for k in dict.fromkeys(lengths):
            per = lengths.count(k)
            lo = rank.get(k, 0)
            slots.append((k, lo, per, base, at))
            rank[k] = lo + per * times
            at += per * k
        base += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)

    before = each.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"])

    def place(batches):
        first = {int(k): i for i, k in reversed(list(enumerate(table[:, 0])))}
        last = {int(k): i + 1 for i, k in enumerate(table[:, 0])}
        for pdf in batches:
            rank = (pdf["before"] + pdf["nth"]).to_numpy()
            row = np.empty(len(pdf), np.int64)
            length = pdf["length"].to_numpy()
            for k in np.unique(length):
                own = length == k
                a, b = first[int(k)], last[int(k)]
                row[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            _, lo, per, base, at = table[row].T
            out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["sequence_id"] = base + (rank - lo) // per
            out["offset"] = at + (rank - lo) % per * length
            yield out

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
