"""The pipeline and each of its stages against brute force."""

import itertools
import random
import re

import corpus_pipeline
import numpy as np
from reelgraph.llm.queries import vocabulary
from tokenizers import Tokenizer

WORDS = [f"w{i}" for i in range(60)]


def near_kept(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in docs.items()}
    top = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    for _ in sets:
        if not any(top[a] != top[b] for a, b in pairs):
            break
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    return {i: t for i, t in docs.items() if top[i] == i}


def without_repeats(docs):
    first, out = {}, {}
    for i, t in sorted(docs.items()):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in docs.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        left = "".join(x for x, g in zip(t, gone, strict=True) if not g)
        if not gone.any() or left.strip():
            out[i] = left
    return out


def clean(docs, items):
    windows = {tuple(w[k : k + 13]) for w in (re.findall(r"[a-z0-9]+", x) for x in items) for k in range(max(1, len(w) - 12))}
    out = {}
    for i, t in docs.items():
        w, hit = re.findall(r"[a-z0-9]+", t), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit.update(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def test_stages_and_their_order(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    docs = {}
    for i in range(600):
        w = [rng.choice(WORDS) for _ in range(60)]
        if i % 3 == 0:
            w[7] = "awful"
        docs[i] = " ".join(x + "###" for x in w) if i % 3 == 1 else " ".join(w)
    planted = {602: docs[2] + " w1", 605: " ".join(docs[5].split()[:25] + [rng.choice(WORDS) for _ in range(60)]), 608: " ".join(docs[8].split()[:30])}
    docs |= planted
    table = [(i, f"s{i % 7}", t, len(t)) for i, t in docs.items()]
    spark.createDataFrame(table, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 3 == 1 else 1, 1 if i % 3 == 0 else 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, docs[11])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    given = []

    def watched(name, apply):
        def stage(spark, d, path):
            given.append((name, d.columns, {r.doc_id: r for r in d.collect()}))
            return apply(spark, d, path)

        return stage

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, f)) for n, f in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    assert [n for n, _, _ in given] == ["quality classifier", "minhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    for _, columns, rows in given:
        assert columns == ["doc_id", "source", "text", "n_chars"]
        assert all(r.source == f"s{i % 7}" and r.n_chars == len(r.text) for i, r in rows.items())
    start, graded, single, cut, left = ({i: r.text for i, r in rows.items()} for _, _, rows in given)
    assert start == docs and all(docs[i] == t for i, t in graded.items())
    assert sum((i in graded) == (i % 3 == 2) for i in range(600)) >= 570 and {2, 5, 8, 11, *planted} <= set(graded)
    assert single == near_kept(graded) and 602 not in single
    assert cut == without_repeats(single) and 608 not in cut and len(cut[605]) < len(docs[605])
    assert left == clean(cut, [docs[11]]) and 11 in cut and 11 not in left
    tok = Tokenizer.from_file(vocabulary())
    total: dict = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_near_dedup_loses_no_text(spark):
    """Rows of one doc_id with different texts, repeated rows, nulls, and columns with the operator's own names."""
    rng = random.Random(2)
    a, b = (" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(2))
    rows = [(0, a + " x"), (1, a), (1, b), (2, None), (2, None), (None, a), (None, a), (3, ""), (4, b), (5, a), (6, b + " y")]
    df = spark.createDataFrame([(*r, "v", k, True) for k, r in enumerate(rows)], "doc_id long, text string, version string, row int, stays boolean")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()), key=str)
    assert got == sorted([(0, a + " x"), (1, b), (2, None), (2, None), (None, a), (None, a), (3, "")], key=str)
    twice = spark.createDataFrame([(1, a, "p"), (1, a, "q"), (2, b, "r")], "doc_id long, text string, kept string")
    out = corpus_pipeline.near_dedup(spark, twice, "")
    assert out.columns == ["doc_id", "text", "kept"] and sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (2, b)]
    assert corpus_pipeline.near_dedup(spark, twice.limit(0), "").count() == 0
