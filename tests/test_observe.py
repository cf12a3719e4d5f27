"""The observation loop, option packs and parsers on cases worked out by hand."""

from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.functions import vectors as V
from reelgraph.operators import observe as O

EDGE = "video_id long, i int, j int, w_norm double"
SCORE = "video_id long, node int, score double"
CHANNEL = "video_id long, option int, node int, score double"
ANSWER = "video_id long, node int, relevance double"


def test_patrol_retries_a_weak_option_and_fills_gaps(spark):
    prior = spark.createDataFrame([(1, n, s) for n, s in enumerate([0.9, 0.5, 0.4, 0.3])], SCORE)
    channels = spark.createDataFrame([(1, -1, 0, 0.9), (1, 0, 1, 0.8), (1, 0, 3, 0.6), (1, 1, 1, 0.7), (1, 1, 2, 0.2)], CHANNEL)
    answers = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.1), (1, 2, 0.4)], ANSWER)
    seen = O.patrol(spark.createDataFrame([], EDGE), prior, channels, answers, most=10)
    rows = [(r.step, r.node, r.option) for r in seen.orderBy("step").collect()]
    # 0 for the question, 1 for option 0; weak, so 3 comes next; 2 is option 1's, as 1 was taken.
    assert rows == [(1, 0, None), (2, 1, 0), (3, 3, 0), (4, 2, 1)]
    best = {r.option: r.node for r in O.best_of_options(seen).collect()}
    assert best == {0: 1, 1: 2}


def test_patrol_keeps_its_limit_and_bears_empty_tables(spark):
    prior = spark.createDataFrame([(1, n, 0.5) for n in range(6)], SCORE)
    none = spark.createDataFrame([], CHANNEL)
    got = O.patrol(spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, 1.0)], EDGE), prior, none, spark.createDataFrame([], ANSWER), most=3)
    assert got.count() == 3 and got.select("node").distinct().count() == 3
    assert O.patrol(spark.createDataFrame([], EDGE), prior.limit(0), none, spark.createDataFrame([], ANSWER)).isEmpty()


def test_option_pack_fills_each_share_and_the_rest(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 10, 11), (1, 2, 12, 19)], "video_id long, node int, s int, e int")
    best = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "video_id long, option int, node int")
    anchors = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "video_id long, option int, node int")
    channels = spark.createDataFrame([(1, 1, 0, 0.4), (1, 1, 2, 0.3)], CHANNEL)
    got = [(r.option, r.frame_idx) for r in O.option_pack(nodes, best, anchors, channels, 2, budget=16).orderBy("pos").collect()]
    assert got[:8] == [(0, f) for f in (12, 14, 16, 18, 0, 2, 5, 7)]
    assert got[8:14] == [(1, f) for f in (10, 11, 0, 2, 5, 7)]
    assert [x for x in got[14:] if x[0] is not None] == [] and len(got) <= 16
    assert got[14:] == [(None, 19)]  # even frames 0 and 19; 0 is there


def test_unlike_first_and_diversity_fill(spark):
    f = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [0.0, 1.0])], "video_id long, frame_idx int, v array<double>")
    assert sorted(r.frame_idx for r in O.unlike_first(f).collect()) == [0, 2, 3]
    x = spark.createDataFrame([(1, 3, 1.0)], "video_id long, frame_idx int, x double")
    got = O.diversity_fill(f, f.where("frame_idx = 0"), x, budget=2)
    assert sorted((r.frame_idx, r.filled) for r in got.collect()) == [(0, False), (3, True)]


def test_parsers(spark):
    t = spark.createDataFrame([("A. x\n(B) y z \nA) last", ["Paris", "  paris", "the", "TEXT: a", "a1", "世界", "plain", None], 'x {"a":{"b":1}} y', "in the first 30 seconds")], "q string, k array<string>, j string, w string")
    r = t.select(T.option_texts(F.col("q")).alias("o"), T.entities(F.col("k")).alias("e"), T.json_found(F.col("j")).alias("j"), V.temporal_focus(F.lit(100), F.col("w"), 8).alias("f"), V.temporal_focus(F.lit(0), F.col("w"), 8).alias("z"), T.truth(F.lit(" Yes"), False).alias("t"), T.most_steps(F.lit(6)).alias("m")).first()
    assert [(x.option, x.text) for x in r.o] == [("B", "y z"), ("A", "last")]
    assert r.e == ["Paris", "TEXT: a", "a1", "世界"] and r.j == '{"b":1}'
    assert r.f == [0, 5, 10, 20, 30] and r.z == [] and r.t is True and r.m == 12
    order = spark.createDataFrame([("10",), ("b",), ("xx",), ("2",), ("A",)], "o string").orderBy(T.option_order(F.col("o")))
    assert [x.o for x in order.collect()] == ["A", "b", "2", "10", "xx"]


def test_words_are_trimmed_of_blanks_only(spark):
    t = spark.createDataFrame([(["0x0", "1B1", "Q"],)], "k array<string>")
    r = t.select(T.clean_keywords(F.col("k")).alias("c"), T.entities(F.col("k")).alias("e")).first()
    assert r.c == ["0x0", "1B1", "Q"] and r.e == ["0x0", "1B1", "Q"]
