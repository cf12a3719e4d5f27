"""Exact dedup, ranked search and hard negatives against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from reelgraph.llm import exact, negatives, search


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def dedup(rows):
    """{(doc_id, text)} -> what is expected, rows of equal id and text told apart by nothing."""
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        g = groups[plain(t)]
        n, none, first = min(g)
        out.append((i, None if none else first, len(g), hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


ODD = [(1, "a b c"), (2, "abc"), (3, " abc\t"), (4, None), (5, ""), (6, " \n"), (7, "é\x0b\x0c\r"), (8, "é"), (8, "é"), (None, "é     "), (None, None), (9, "x" * 100_000), (10, "x y" * 7), (10, "xy " * 7), (11, "\xa0abc"), (12, "ABC")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    """weak: a digest under which many texts collide; the groups stay the same."""
    rng = random.Random(3)
    rows = ODD + [(100 + k, rng.choice(["p q", "pq", "r", "s  s", "t" * 9])) for k in range(60)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, row int, hash string").repartition(3)
    digest = (lambda c: F.substring(c, 1, 1).cast("binary")) if weak else exact.md5
    got = exact.exact_duplicates(df, digest, carry=("row",)).collect()
    want, groups = dedup(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups and all(r.carried.row == 1 for r in got)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_of_an_empty_table_and_of_many_groups(spark, monkeypatch):
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    monkeypatch.setattr(exact, "SHARED", 0)  # texts of all rows are compared
    monkeypatch.setattr(exact, "HOT", 3)
    rows = [(k, f"t{k % 7}" if k % 2 else "hot") for k in range(90)]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == dedup(rows)[0]


def test_texts_of_a_group_are_compared(spark):
    """With both digests alike for two texts the comparison must not pass."""
    groups = spark.createDataFrame([(bytearray(b"h"), bytearray(b"s"), 2)], "hash binary, second binary, size long")
    texts = spark.createDataFrame([(bytearray(b"h"), "a"), (bytearray(b"h"), "a")], "hash binary, norm string")
    exact._compare(texts, groups)
    mixed = texts.union(spark.createDataFrame([(bytearray(b"h"), "b")], "hash binary, norm string"))
    exact._compare(mixed, groups)  # told apart by the second digest
    import unittest.mock as mock

    with mock.patch.object(exact.F, "sha2", lambda c, n: F.lit("00")), pytest.raises(ValueError):
        exact._compare(mixed, groups)


def terms(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranking(docs, items, top=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        got = []
        for i, c in own:
            m = 10 + (90 * c.total() * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                got.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(got)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "pairs", "top"), [(40, 1 << 17, 10), (300, 20, 3), (1 << 20, 1, 1)])
def test_ranked_search(spark, tmp_path, shard, pairs, top):
    rng = random.Random(7)
    words = ["the"] * 30 + [f"w{k}" for k in range(40)] + ["Éa", "éa", "x-1", "İ", "漢字"]
    docs = [(k * 3 % 101, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(101)]
    docs += [(5, docs[4][1]), (5, docs[4][1]), (None, docs[4][1]), (None, None), (200, ""), (-4, "w1 " * 5000), (201, ";; --")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(12)] + [(50, None), (51, "nothing"), (None, "w1 W1 w2"), (0, "w3")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, item int").repartition(2)
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    index = search.build_index(df, f"file://{tmp_path}/index", shard)
    got = search.search(index, asked, top, pairs)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=str) == ranking(docs, items, top)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked_search(none, item).count() == 0
    assert search.ranked_search(some, item.where("false")).count() == 0


def test_postings_keep_their_numbers():
    values = np.array([0, 1, 127, 128, 300, 2**21, 2**40, 5], np.int64)
    raw, at = search.packed(values)
    assert search.unpacked(raw.tobytes()).tolist() == values.tolist()
    assert search.unpacked(raw[at[3] : at[6]].tobytes()).tolist() == values[3:6].tolist()


def test_pruned_merging_equals_all_scores():
    rng = random.Random(1)
    for _ in range(200):
        cursors, every = [], Counter()
        for _ in range(rng.randint(1, 8)):
            c = object.__new__(search.Cursor)
            c.docs = sorted(rng.sample(range(200), rng.randint(1, 120)))
            c.ratios = [rng.randint(1, 9) for _ in c.docs]
            c.most, w = max(c.ratios), rng.choice([1, 1, 5, 50])
            cursors.append((w, c))
            for d, r in zip(c.docs, c.ratios, strict=True):
                every[d] += w * r
        top = rng.randint(1, 6)
        assert search.best_documents(cursors, top) == [(s, d) for s, d in sorted(((s, d) for d, s in every.items()), key=lambda x: (-x[0], x[1]))[:top]]


def mined(rows, positives=5, negatives=3):
    own = [(i, label, [math.floor(256 * x) for x in v], k) for k, (i, v, label) in enumerate(rows) if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v, k in own:
        if i % 50:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other == label) for j, other, w, n in own if n != k)
        for s, j, _ in [x for x in near if x[2]][:positives]:
            far = [x for x in near if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize(("tile", "turn"), [(7, 3), (4096, 8192)])
def test_hard_negatives(spark, tile, turn):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 12))
    rows = []
    for k in range(400):
        label = int(rng.integers(4))
        v = centre[label % 3] + rng.normal(size=12) * 0.5
        rows.append((k, [float(x) for x in np.round(v / np.linalg.norm(v), 2)], label))
    rows += [(50, rows[3][1], 1), (500, rows[0][1], 0), (501, rows[0][1], 1), (502, rows[0][1], 1), (550, [0.0] * 12, 2), (600, [-1.0] * 12, 1), (601, None, 1), (602, rows[0][1], None)]
    rows += [(603, [float("nan")] * 12, 1), (604, [float("inf")] + [0.0] * 11, 1), (605, [None] + [0.5] * 11, 1), (None, rows[0][1], 1), (606, rows[1][1][:5], 0), (607, [], 1), (650, [], 1)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, label int, score double").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, tile=tile, round_=turn).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(one, F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_drop_no_pair():
    """Every pair within its range survives, whatever the size of the components."""
    rng = np.random.default_rng(4)
    for size in (1, 200, 1 << 24):
        x = rng.integers(-size, size + 1, (60, 16))
        turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
        parts = [2, 4, 8, 16]
        ids = np.arange(60)
        block = negatives.Block(ids, ids, ids, x.astype(np.int32), turn, parts)
        exact_ = x.astype(object) @ x.T.astype(object)
        lo = np.quantile(exact_.astype(float), 0.9, axis=1)
        hi = np.quantile(exact_.astype(float), 0.98, axis=1)
        i, j = negatives.candidates(block, ids, block, slice(0, 60), lo, hi, parts, 2.0**-23 * 24)
        have = set(zip(i.tolist(), j.tolist(), strict=True))
        assert {(a, b) for a in range(60) for b in range(60) if lo[a] <= exact_[a, b] <= hi[a]} <= have
        assert len(have) < 3600
