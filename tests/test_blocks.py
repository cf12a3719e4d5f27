"""Steps that go in blocks, held against plain loops; and that their work grows with the input only."""

import math
import random
import time

from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.operators import graph, scores, selection


def test_belief_history_over_many_blocks(spark):
    rng = random.Random(5)
    seen = [(1, 3 * k + 1, rng.randrange(12), rng.choice([0.0, 0.3, 0.6, 0.7, 0.9])) for k in range(2 * selection.BLOCK + 7)]
    first = {f: (rng.uniform(-0.5, 1.5), 1.0) for f in range(12)}
    want = {(1, 0, f): x for f, x in first.items()} | {(2, 0, 4): (0.5, 1.0)}
    for f, (mu, sigma) in first.items():
        for _, step, t, r in seen:
            bump = lambda w: math.exp(-((f - t) ** 2) / (2 * w * w))
            mu = mu + r * bump(1.5) if r > 0.6 else mu * (1 - 0.5 * bump(4.0))
            mu, sigma = min(max(mu, 0), 1), min(max(sigma * (1 - bump(4.0)), 0), 1)
            want[1, step, f] = mu, sigma
    b = spark.createDataFrame([(1, f, *x) for f, x in first.items()] + [(2, 4, 0.5, 1.0)], "video_id long, frame_idx int, mu double, sigma double")
    got = {(r.video_id, r.step, r.frame_idx): (r.mu, r.sigma) for r in selection.belief_history(b, spark.createDataFrame(seen, "video_id long, step int, t int, relevance double")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k], strict=True))


def quick(rows, seconds=8.0):
    """Collected within so many seconds; what is made anew for every element takes minutes."""
    at = time.monotonic()
    got = rows.collect()
    assert time.monotonic() - at < seconds
    return got


def test_pieces_of_a_long_text(spark):
    t = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: i.cast("string")), " ").alias("t"))
    t.count()
    (r,) = quick(t.select(T.pieces(F.col("t")).alias("p")).select(F.size("p").alias("n"), F.element_at("p", -1).alias("last")))
    assert r.n == 4000 and r.last.split() == [str(i) for i in range(199_951, 200_001)]


def test_start_of_a_text_as_evidence(spark):
    rows = [(1, 1, "asr", 0.5, "a" * 300), (1, 2, "asr", 0.5, " \n x  y "), (1, 3, "asr", 0.5, "  "), (1, 4, "asr", 0.5, ""), (1, 5, "asr", 0.5, None), (1, 6, "asr", 0.5, "\n")]
    got = {r.step: (r.text, r.says) for r in scores.best_channel(spark.createDataFrame(rows, "video_id long, step int, source string, score double, text string")).collect()}
    assert got == {1: ("a" * 180 + "...", True), 2: ("x y", True), 3: ("", False), 4: (None, False), 5: (None, False), 6: ("", True)}


def test_timeline_of_many_lines(spark):
    t = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("- line number "), i.cast("string"))), "\n").alias("t"))
    t.count()
    (r,) = quick(t.select(T.timeline_lines(F.col("t"), F.lit(60.0)).alias("e")).select(F.size("e").alias("n"), F.element_at("e", -1).alias("last")))
    assert r.n == 20_000 and r.last.description == "line number 20000" and abs(r.last.end - 60) < 1e-9


def test_entities_of_many_words(spark):
    t = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("Name"), (i % 1500).cast("string"))).alias("k"))
    t.count()
    (r,) = quick(t.select(T.entities(F.col("k")).alias("e")).select(F.size("e").alias("n"), F.get("e", F.lit(0)).alias("first")))
    assert (r.n, r.first) == (1500, "Name1")


def test_tfidf_moves_texts_once(spark):
    """Words that repeat everywhere, texts without words, and phrases with words that no text has."""
    texts = [(1, ["a1", "b1", "a1"]), (2, ["b1", "c1"]), (3, []), (4, None), (5, ["d1"])]
    phrases = [(10, ["a1", "x1"]), (11, ["b1", "c1"]), (12, [])]
    t = spark.createDataFrame(texts, "id long, tokens array<string>")
    got = graph.tfidf(t, spark.createDataFrame(phrases, "phrase long, tokens array<string>"))
    idf = {k: math.log(7 / (1 + n)) + 1 for k, n in {"a1": 2, "b1": 2, "c1": 1, "d1": 1, "x1": 0}.items()}
    vector = lambda ws: {w: ws.count(w) / len(ws) * idf[w] for w in ws or []}
    want = {}
    for i, a in texts:
        for p, b in phrases:
            u, v = vector(a), vector(b)
            if u.keys() & v.keys():
                want[i, p] = sum(u[w] * v[w] for w in u.keys() & v.keys()) / math.hypot(*u.values()) / math.hypot(*v.values())
    rows = {(r.id, r.phrase): r.score for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-12 for k in want)
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert dealt and all("REPARTITION_BY_COL" in x for x in dealt)  # all else meets where the texts lie


def test_tfidf_of_more_words_than_are_sent(spark, monkeypatch):
    """Frequent words and those of phrases are sent, others weighed apart: the same scores, and no text's words are dealt by word."""
    rng = random.Random(3)
    texts = [(i, [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(30)]) for i in range(40)] + [(40, ["once"]), (41, ["w1", "w1", "twice", "twice"]), (42, [])]
    texts += [(42, ["w1", "again"]), (42, ["w1", "again", "more"])]
    phrases = [(1, ["w1", "w2", "none"]), (2, ["w7", "once"]), (3, ["w399", "w398", "w1"])]
    t, p = spark.createDataFrame(texts, "id long, tokens array<string>"), spark.createDataFrame(phrases, "phrase long, tokens array<string>")
    want = {(r.id, r.phrase): r.score for r in graph.tfidf(t, p).collect()}
    assert (40, 2) in want and (41, 1) in want and (42, 1) in want
    monkeypatch.setattr(graph, "BROADCAST_WORDS", 8)
    monkeypatch.setattr(graph, "TASK_WORDS", 300)
    got = graph.tfidf(t, p)
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert dealt and all("hashpartitioning(id#" in x for x in dealt)  # by id, and none by word
    rows = {(r.id, r.phrase): r.score for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-12 for k in want)


def test_the_most_frequent_words(spark):
    freq = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 4), ("e", 1)], "tok string, n long")
    kept = lambda most: sorted(r.tok for r in freq.where(graph.most_frequent(freq, most)).collect())
    assert [kept(k) for k in (1, 2, 3, 4, 5)] == [[], ["a", "b"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
