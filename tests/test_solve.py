"""Whole searches on small videos, held against the single operators."""

import json
import subprocess
import sys

import numpy as np
import pytest
import sequential as Q
from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.functions import vectors as V
from reelgraph.models import StandIn, hashed, words
from reelgraph.operators import final, graph, kernels, rounds, selection
from reelgraph.operators import solve as A
from reelgraph.operators.solve import planned
from reelgraph.settings import Settings
from reelgraph.workers import ROOT, Scratch

SCENES = ["a red car drives along the coast", "two dogs play with a ball", "a man cooks soup in a kitchen", "children sing in a choir", "a storm over the sea", "a train leaves the station"]
QUESTION = "What do the dogs do?\nA. They play with a ball\nB. They sing\nC. They cook soup"


def frames_of(video, per=15):
    rng = np.random.default_rng(video)
    return [(video, i * per + k, (hashed(t) + rng.normal(0, 0.01, 64)).tolist()) for i, t in enumerate(SCENES) for k in range(per)]


# A lambda goes to workers as it is; a function of this module would be looked up there by name.
stand_in = lambda: StandIn({(v, i * 15 + k): t for v in (1, 2) for i, t in enumerate(SCENES) for k in range(15)}, {(1, 20): "BALL GAME"})


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(frames_of(1) + frames_of(2), "video_id long, frame_idx int, v array<double>").repartition(3)


def test_a_question_is_answered_by_its_evidence(spark, frames):
    asked = [(1, 10, QUESTION), (1, 11, QUESTION.replace("What", "Which statement is not correct: what")), (2, 12, "How many trains?"), (3, 13, QUESTION), (2, 14, None)]
    heard = spark.createDataFrame([(1, 17, "the dogs play ball"), (1, 18, "the dogs play ball")], "video_id long, frame int, said string")
    got = {r.question_id: r for r in A.solve(frames, spark.createDataFrame(asked, "video_id long, question_id long, question string"), stand_in, heard, Settings(threshold=0.5)).collect()}
    assert set(got) == {10, 11, 12, 13, 14}
    assert got[10].answer == "A" and got[10].options == ["A", "B", "C"] and got[10].segments == 6
    assert any(any(c in x.line for c in ("ASR", "OCR", "CAPTION")) for x in got[10].lines) and any("ball" in x.line.lower() for x in got[10].lines)
    for q in (10, 11, 12, 14):
        assert 0 < len(got[q].frames) <= 32 and max(got[q].frames) < 90 and len(got[q].steps) <= 10
        assert got[q].fallback or q == 11 or got[q].frames == sorted(set(got[q].frames))
    assert got[13].answer == "Error" and got[13].frames == []
    truth = spark.createDataFrame([(10, "a)"), (13, "A")], "question_id long, letter string")
    answers = spark.createDataFrame([(10, "A"), (13, "Error")], "question_id long, answer string")
    assert A.accuracy(answers, truth).first().accuracy == 0.5
    assert json.loads(A.as_json(answers).where("question_id = 10").first().record)["answer"] == "A"


def test_segments_follow_the_scenes(frames):
    got = sorted((r.video_id, r.node, r.s, r.e) for r in graph.segments(frames, 0.5, 10).collect())
    assert got == [(v, k, 15 * k, 15 * k + 14) for v in (1, 2) for k in range(6)]


def test_bounds_fold_as_told():
    """Every walk, against a list of segments that is rewritten in place."""

    def told(x, threshold, least):
        segs, cur = [], 0
        for i in range(1, len(x)):
            if x[i - 1] @ x[i] < threshold:
                segs.append([cur, i])
                cur = i
        segs.append([cur, len(x)])
        mean = lambda s: x[s[0] : s[1]].mean(axis=0)
        again = True
        while again:
            again, out, rest = False, [], [list(s) for s in segs]
            while rest:
                s = rest.pop(0)
                if s[1] - s[0] < least:
                    left = mean(out[-1]) @ mean(s) if out else -1
                    right = mean(rest[0]) @ mean(s) if rest else -1
                    if left > 0 and left >= right:
                        out[-1][1], again = s[1], True
                        continue
                    if right > 0:
                        rest[0][0], again = s[0], True
                        continue
                out.append(s)
            segs = out
        return [s[0] for s in segs] + [len(x)]

    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = kernels.unit(rng.normal(0.1, 1, (int(rng.integers(1, 60)), 5)))
        assert kernels.bounds_of(x, 0.1, int(rng.integers(1, 9)))[0] or True
        for least in (1, 4, 9):
            assert kernels.bounds_of(x, 0.1, least)[0] == told(x, 0.1, least)


def same(got, video, question, models, heard=None, given=None, steps=10, budget=32, x=None):
    """A row of solve() against the search in plain Python."""
    x = np.array([v for _, _, v in frames_of(video)]) if x is None else x
    want = Q.Search(video, x, question or "", models, heard or {}, given or Settings(threshold=0.5), steps, budget).solve()
    assert [(s.node, s.option, s.caption) for s in got.steps] == [(s["node"], s["option"], s["caption"]) for s in want["steps"]]
    for a, b in zip(got.steps, want["steps"], strict=True):
        assert [a.relevance, a.asr_score, a.ocr_score, a.caption_score] == pytest.approx([b["relevance"], b["asr_score"], b["ocr_score"], b["caption_score"]], abs=1e-9)
    assert got.belief == pytest.approx(want["belief"], abs=1e-9)
    assert (got.fallback, got.frames, got.options, got.segments) == (want["fallback"], want["frames"], want["options"], want["segments"])
    assert [(x.pos, x.line) for x in got.lines] == [(x["pos"], x["line"]) for x in want["lines"]]
    assert (got.answer, got.raw) == (want["answer"], want["raw"])


OTHERS = ["Who cooks?\nA. A man\nB. Two dogs\nC. A choir of children\nD. The storm\nE. The train", "Which is incorrect about the Coast Road?\nA. a red car drives\nB. soup", "How many trains leave?", "", "What said the Narrator Options: ['A. Singing in a choir', 'B. Storm over sea']"]


def test_whole_searches_equal_the_sequential_ones(spark, frames):
    asked = [(v, 100 * v + k, t) for v in (1, 2) for k, t in enumerate([QUESTION, *OTHERS])]
    said = {17: "the dogs play ball", 18: "the dogs play ball", 40: "soup is ready now"}
    heard = spark.createDataFrame([(1, k, t) for k, t in said.items()], "video_id long, frame int, said string")
    q = spark.createDataFrame(asked, "video_id long, question_id long, question string")
    for given, budget in ((Settings(threshold=0.5), 32), (Settings(threshold=0.5, model_relevance=True, several_routes=False), 12)):
        got = {r.question_id: r for r in A.solve(frames, q, stand_in, heard, given, budget=budget).collect()}
        for v, k, t in asked:
            same(got[k], v, t, stand_in(), said if v == 1 else {}, given, budget=budget)


def test_what_an_observer_misses_is_searched_for(spark, frames):
    """Words for the next look, tagged ones that cost a step, replies that can't be read, and calls that fail."""

    def factory():
        import json

        from reelgraph.models import StandIn

        class Asking(StandIn):
            def observe(self, video_id, frames, question, with_relevance):
                first = frames[0]
                if first < 15:
                    return "no json"
                if first < 30:
                    raise ValueError("down")
                more = {30: "train station", 45: "TEXT: sign", 60: "train"}.get(first, None)
                return json.dumps({"relevance": "0.25", "caption": f"scene {first} with a red car", "ocr": ["SIGN", "ab"], "refinement_plan": {"needs_more_info": bool(more), "missing_visual_keyword": more}})

            def answer(self, video_id, frames, prompt, system):
                if "video 2" in prompt:
                    raise RuntimeError("gone")
                return "Final Answer: B" if "single letter" in system else "unclear"

        return Asking({}, {})

    asked = [(1, 1, QUESTION), (2, 2, "Where is video 2?\nA. here\nB. there"), (1, 3, "Show the Red Car")]
    q = spark.createDataFrame(asked, "video_id long, question_id long, question string")
    given = Settings(threshold=0.5, model_relevance=True)
    got = {r.question_id: r for r in A.solve(frames, q, factory, None, given).collect()}
    for v, k, t in asked:
        same(got[k], v, t, factory(), {}, given)
    assert got[2].answer == "Error" and got[1].answer == "B" and "[RETRY]" in got[1].raw


def test_states_stay_where_they_are(spark, frames):
    """Without broadcasts, as on large tables: a round moves what was seen, but no state with its graph, and no search leaves tables."""
    asked = [(v, 10 * v + k, QUESTION) for v in (1, 2) for k in range(4)]
    cases = spark.createDataFrame(asked, "video_id long, question_id long, question string").withColumn("case", F.col("question_id"))
    heard = spark.createDataFrame([(1, 17, "the dogs play ball")], "video_id long, frame int, said string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with Scratch(spark):
            s = A.Search(frames, cases, stand_in, heard, Settings(threshold=0.5), 10, 32)
            rows = s.pick(s.start()).where("node IS NOT NULL")
            after = rounds.looked(s.look(rows, 1))
            plan = spark._jvm.PythonSQLUtils.explainString(after._jdf.queryExecution(), "formatted")
            moved = [x.split("\n")[1] for x in plan.split("\n\n") if ") Exchange\n" in x + "\n"]
            assert "near#" in plan and moved and not any("near#" in x for x in moved)
            assert after.count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x.name for x in spark.catalog.listTables() if "reelgraph" in x.name]


def test_states_of_a_session_that_can_hold_no_tables():
    """Where no warehouse can be made, states are kept without a table."""
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "file:///dev/null/none").getOrCreate()
from reelgraph.workers import Scratch, beside, dealt, tables
with Scratch(spark):
    held = tables(spark)
    rows = dealt(spark.range(10).withColumnRenamed("id", "video_id"), "video_id", 2, held)
    more = spark.range(5).selectExpr("id AS video_id", "id * 2 AS x")
    print("rows", held, beside(rows, more, "video_id", 2).count(), beside(rows, more, "video_id", 2, "left").count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, timeout=120)
    assert "rows False 5 10" in done.stdout, done.stderr[-2000:]


def test_many_requests_go_in_one_call(spark):
    def factory():
        class Many:
            def plan(self, question):
                if question == "q5":
                    raise ValueError("five")
                return question + "!"

            def plan_many(self, requests):
                if len(requests) > 4 or ("q5",) in requests:
                    raise ValueError("not these")
                return [q + "?" for (q,) in requests]

        return Many()

    rows = spark.range(10).selectExpr("concat('q', id) AS q").coalesce(1)
    got = {r.q: r.r for r in rows.withColumn("r", A.reply(factory, "plan", F.col("q"), most=4)).collect()}
    assert [got[f"q{k}"].text for k in range(10)] == ["q0?", "q1?", "q2?", "q3?", "q4!", None, "q6!", "q7!", "q8?", "q9?"] and got["q5"].error == "five"


def test_weak_evidence_falls_back(spark, frames):
    q = spark.createDataFrame([(1, 1, "Who won the election of 1950?\nA. Nobody\nB. Somebody")], "video_id long, question_id long, question string")
    r = A.solve(frames, q, StandIn, given=Settings(threshold=0.5)).first()
    assert r.fallback and r.frames == Q.even(90, 32) and r.answer in ("A", "B")


def test_no_questions_and_no_frames(spark, frames):
    q = spark.createDataFrame([(9, 1, "Who?")], "video_id long, question_id long, question string")
    assert A.solve(frames, q.limit(0), StandIn).count() == 0
    assert [(r.answer, r.frames, r.steps) for r in A.solve(frames, q, StandIn).collect()] == [("Error", [], [])]


PLANS = [
    ('{"option_keywords": {"A": ["Red car"]}, "semantic_queries": {"B": "If the answer is B, the video should show: dogs"}, "query_keywords": ["which", "Eiffel"]}', "Which?\nA. x\nB) y\n(C) some words here"),
    ("no json", "Where is the tall tower?"),
    ("[1, 2]", "Where is it"),
    ('```json\n{"option_keywords": {"A": [], "B.*": ["text: X", "y"]}, "vlm_query": " ask ", "general_semantic_query": "all"}\n```', "Q"),
    ('{"temporal_plan": {"first": ["x"]}, "query_keywords": []}', "What does Bob do first"),
    ("{}", "Options: ['A. some thing', 'B. other thing']"),
]


def test_plans(spark):
    def factory():
        class Told:
            def plan(self, question):
                return replies[int(question.split("#")[1])]

        replies = [p for p, _ in PLANS]
        return Told()

    rows = spark.createDataFrame([(k, f"{q}\n#{k}") for k, (_, q) in enumerate(PLANS)], "case long, question string")
    for r in planned(rows, factory, Settings(), 10).collect():
        want = Q.plan_of(PLANS[r.case][0], r.question)
        assert {o.option: o.words for o in r.opts} == want.words and {o.option: o.sentence for o in r.opts if o.sentence} == {k: v for k, v in want.sentences.items() if v}
        assert (r.words, r.general, r.asked) == (want.question_words, want.general, want.asked)


def test_letters():
    assert Q.letters("Q Options: ['A. x', 'C: y']\n(D) z\nE.none") == ["A", "C", "D"]
    assert [Q.letter_of(t, []) for t in ("I think B is right", "final answer: c", "unclear", "")] == ["B", "C", Q.NONE, Q.NONE] and Q.letter_of("Final Answer: D", ["A"]) == Q.NONE
    assert Q.timeline("[00:30-00:10] x", 60) == [(30.0, 35.0, "x")] and Q.timeline("[01:00:00-01:02:00] x y", 10)[0][2].startswith("[01:00")


def V_times(q, n):
    """What must be among the frames: both ends of the times that a question names."""
    return (0, 30) if "30" in q else (n - n // 10, n - 1)


def test_expressions_agree_with_the_search(spark):
    for q, n in (("What happens in the first 30 seconds?", 400), ("how does it end", 90)):
        got = spark.range(1).select(V.focused_indices(F.lit(n), F.lit(q), F.lit(True), 12).alias("f")).first().f
        assert len(got) == 12 and got[0] == 0 and set(V_times(q, n)) <= set(got)
    text = "Two dogs, TEXT: a 7 é ball"
    row = spark.range(1).select(T.tokens(F.lit(text)).alias("t"), T.embedding(T.tokens(F.lit(text))).alias("u")).first()
    assert row.t == words(text) and np.allclose(row.u, hashed(text))


def test_picked_frames():
    x = np.eye(8)[[0, 0, 1, 1, 2, 3, 4, 5]]
    assert final.picked(x, [0], [1, 2, 3], None, 3) == [0, 2, 3]  # 1 is like the first of all
    assert final.picked(x, [0], [1, 2], None, 4, near=0.5) == [0, 1, 2, 3]  # the least similarity counts, and 1 is unlike 2
    assert final.picked(x, [0], [], np.array([0, 0, 0, 0, 0, 0, 1.0, 0]), 2) == [0, 6]


def test_empty_graphs():
    v = kernels.unit(np.ones((1, 4)))
    i, j, w, wn = kernels.edges(v, np.zeros(1))
    assert len(i) == 0 and kernels.spread(i, j, wn, np.ones(1), np.zeros(1)).tolist() == pytest.approx([0.4])
    assert kernels.spaced(np.array([-1.0, 0.0]), i, j) == []
    a = kernels.edges(kernels.unit(np.random.default_rng(1).normal(size=(40, 6))), np.arange(40.0))
    kernels_block, kernels.BLOCK = kernels.BLOCK, 7
    try:
        b = kernels.edges(kernels.unit(np.random.default_rng(1).normal(size=(40, 6))), np.arange(40.0))
    finally:
        kernels.BLOCK = kernels_block
    assert all(np.allclose(p, q) for p, q in zip(a, b, strict=True))


def test_belief_operators(spark):
    b = spark.createDataFrame([(1, i, 0.1 * i, 1.0) for i in range(5)], "video_id long, frame_idx int, mu double, sigma double")
    seen = spark.createDataFrame([(1, 1, 2, 0.95), (1, 2, 4, 0.1)], "video_id long, step int, t int, relevance double")
    last = {r.frame_idx: r.mu for r in selection.update_belief(b, seen).collect()}
    assert {r.frame_idx: r.mu for r in selection.belief_history(b, seen).where("step = 2").collect()} == last
    assert not selection.confidence(b, seen).first().stop and selection.confidence(selection.update_belief(b, seen.where("step = 1")), seen.where("step = 1")).first().stop
    x = np.repeat(np.eye(4), 5, axis=0)
    f = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, 0, [1.0, 0.0, 0.0, 0.0])], "video_id long, frame_idx int, v array<double>")
    got = sorted((r.video_id, r.frame_idx) for r in selection.spectral_anchors(f, 4).collect())
    assert [(v, i // 5) for v, i in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
