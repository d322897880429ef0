import random
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import schedules
from sparkloom.functions.costs import flops_per_token
from sparkloom.operators import runlog, scoring, sequences


def log(spark, rows):
    return spark.createDataFrame(rows, "run_id string, global_step bigint, v double")


def test_best_streak_and_fold_agree(spark):
    rows = [("a", i, v) for i, v in enumerate([5.0, 4.0, 4.0, 4.5, 3.0, 3.5, 3.6, None])] + [("b", 0, None)]
    p = runlog.progress(log(spark, rows), "v").orderBy("global_step").collect()
    assert [r.best for r in p] == [5, 4, 4, 4, 3, 3, 3] and [r.streak for r in p] == [0, 0, 1, 2, 0, 1, 2]
    stop = runlog.early_stop(log(spark, rows), "v", min_delta=0.0, patience=2).collect()
    assert [(r.run_id, r.stop, r.scale, r.best) for r in stop] == [("a", 3, 0.5, 4.0)]


def test_first_last_and_argmin_ties(spark):
    t = runlog.summarize_runs(log(spark, [("a", 2, 1.0), ("a", 1, 1.0), ("a", 3, None)]), "v", "v").collect()[0]
    assert (t.n_steps, t.last_step, t.last_loss, t.best_step) == (3, 3, 1.0, 1)


def test_clean_log_keeps_latest_and_drops_nan(spark):
    rows = [("a", 1, float("nan"), 1), ("a", 1, 2.0, 2), ("a", 1, 2.0, 2), (None, 1, 1.0, 1), ("a", None, 1.0, 1)]
    t = spark.createDataFrame(rows, "run_id string, global_step bigint, v double, arrived_at int")
    assert [(r.run_id, r.v) for r in runlog.clean_log(t).collect()] == [("a", 2.0)]
    assert runlog.clean_log(t.limit(0)).count() == 0


def test_nearest_rank_rounds_half_even(spark):
    r = random.Random(2)
    rows = [("a", float(i)) for i in range(1, 12)]  # 0.95 * 10 = 9.5 -> 10
    rows += [("b", r.random()) for _ in range(3000)] + [("c", float(r.randint(0, 2))) for _ in range(500)] + [("d", 7.0)] * 300 + [("e", None), ("f", 1.0)]
    t = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: x.p for x in runlog.nearest_ranks(t, "g", "v", 0.95, "p").collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert got == {g: sorted(vs)[round(0.95 * (len(vs) - 1))] for g, vs in by.items() if vs[0] is not None}
    assert got["a"] == 11.0 and runlog.nearest_ranks(t.limit(0), "g", "v", 0.95, "p").count() == 0


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_chunks_of_a_run_equal_the_whole(spark, monkeypatch, chunk):
    monkeypatch.setattr(runlog, "CHUNK_STEPS", chunk)
    r = random.Random(chunk)
    rows = [(run, step, r.choice([None, round(r.random(), 2)])) for run in ("a", "b") for step in sorted(r.sample(range(100), 40))]
    t = log(spark, rows)
    carried = {(x.run_id, x.global_step): x.last for x in runlog.carry_forward(t, "v", "last").collect()}
    moved = {(x.run_id, x.global_step): (x.best, x.improved, x.streak) for x in runlog.progress(t, "v").collect()}
    for run in ("a", "b"):
        last, best, streak = None, None, 0
        for _, step, v in (x for x in rows if x[0] == run):
            last = v if v is not None else last
            assert carried[run, step] == last
            if v is not None:
                improved = best is None or v < best
                best, streak = (v, 0) if improved else (best, streak + 1)
                assert moved[run, step] == (best, improved, streak)


def test_sweep_statistics(spark):
    t = spark.createDataFrame([("x", 0.9, True), ("x", 0.7, False), ("y", 1.0, True), ("y", None, True)], "g string, v double, f boolean")
    got = {r.g: (r.n, round(r.mean, 3), round(r.std, 3), r.all_true, r.any_true) for r in runlog.group_stats(t, "g", "v", "f").collect()}
    assert got == {"x": (2, 0.8, 0.1, False, True), "y": (2, 1.0, 0.0, True, True)}
    bad = runlog.first_below(t.withColumn("o", F.lit(1)), "g", "o", F.col("v"), 0.8)
    assert {r.g: r.first_value for r in bad.collect()} == {"x": 0.7, "y": None}


def test_registry_and_melt(spark):
    t = spark.createDataFrame([("r", "running", 1, {"a": "1"}), ("r", "done", 2, {"a": "2"}), ("r", "done", 2, {"a": "2"})], "run_id string, status string, at int, params map<string,string>")
    got = runlog.latest(t, "run_id", "at").collect()
    assert [(r.status, r.params) for r in got] == [("done", {"a": "2"})]
    m = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}), (None, {"c": "3"})], "o map<string,string>, n map<string,string>").select(runlog.merge_params(F.col("o"), F.col("n")))
    assert [r[0] for r in m.collect()] == [{"a": "1", "b": "2"}, {"c": "3"}]
    w = spark.createDataFrame([(1, 2.0, True, None)], "id int, x double, ok boolean, z double")
    assert sorted((r.metric, r.value) for r in runlog.melt(w, ["id"], ["x", "ok", "z"]).collect()) == [("ok", 1.0), ("x", 2.0)]


def test_schedules(spark):
    t = spark.createDataFrame([(0,), (9,), (10,), (99,), (199,), (500,)], "s int")
    lr = [round(r[0], 6) for r in t.select(schedules.lr_for_step(F.col("s"), 1.0, 10, cosine=True, least=0.1, start=100, end=200)).collect()]
    assert lr == [0.1, 1.0, 1.0, 1.0, 0.1, 0.1]
    w = [r[0] for r in spark.createDataFrame([(3,), (4,), (5,), (30,)], "s int").select(schedules.ramp(F.col("s"), 4, 2, 0.5)).collect()]
    assert w == [0.0, 0.25, 0.5, 0.5]
    one = F.lit(1)
    assert spark.range(1).select(flops_per_token(F.lit("transformer"), one, one, one, one, one, one, one, one, F.lit(0.0))).collect()[0][0] == 8 + 4 + 6 + 2


def test_scores(spark):
    t = spark.createDataFrame([("has key", ["key", "gone"], 100), ("key", ["key"], 2), ("key", None, None)], "t string, need array<string>, cap int")
    got = [(r.missing, r.n_present, r.passed) for r in scoring.substring_score(t, "t", "need", "cap").collect()]
    assert got == [(["gone"], 1, False), ([], 1, False), ([], 0, True)]
    c = scoring.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "e string, p string"), "e", "p")
    assert tuple(scoring.accuracy(c).collect()[0]) == (2, 1, 0.5)
    assert scoring.accuracy(c.limit(0)).collect()[0].accuracy is None


def arrays(spark, *v):
    return spark.createDataFrame([([float(x) for x in a],) for a in v], "v array<double>")


def test_anchors(spark):
    b = arrays(spark, [10, 80, 20, 70, 5, 99, 6, 98]).select(F.explode(sequences.blocks(F.col("v"), 4)).alias("b"))
    assert [r[0] for r in b.select(sequences.anchors_top(F.col("b.part"), F.col("b.block"), 4, 2)).collect()] == [[1, 3], [5, 7]]
    u = arrays(spark, range(16)).select(F.explode(sequences.blocks(F.col("v"), 8)).alias("b"))
    assert [r[0] for r in u.select(sequences.anchors_uniform(F.size("b.part"), F.col("b.block"), 8, 4)).collect()] == [[0, 2, 5, 7], [8, 10, 13, 15]]
    h = spark.createDataFrame([([10.0, 80.0, 20.0, 70.0], [100.0, 1.0, 90.0, 80.0])], "ids array<double>, s array<double>")
    assert h.select(sequences.anchors_hybrid(F.col("ids"), F.col("s"), F.lit(0), 4, 3, 1)).collect()[0][0] == [0, 1, 2]
    short = arrays(spark, [1, 2, 3, 4, 5]).select(F.explode(sequences.blocks(F.col("v"), 4)).alias("b"))
    assert [r[0] for r in short.select(sequences.anchors_top(F.col("b.part"), F.col("b.block"), 4, 2)).collect()] == [[2, 3], [4, 4]]


def test_sequence_operators(spark):
    tok = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcabx")], "k int, pos int, token string")
    m = sequences.causal_matches(tok, "k").orderBy("pos").collect()
    assert [r.matches for r in m] == [0, 0, 0, 1, 1, 0] and round(m[4].p, 3) == 0.25
    f = sequences.key_follow(tok, "k", least_gap=2, most_occurrences=8).orderBy("pos").collect()
    assert [r.predicted for r in f] == [None, None, None, "b", "c", None]
    b = sequences.boundaries(tok, "k", F.col("token") == "b").orderBy("pos").collect()
    assert [r.last_boundary for r in b] == [-1, 1, 1, 1, 4, 4] and [r.segment for r in b] == [0, 0, 1, 1, 1, 2]
    t = spark.createDataFrame([(1, i, float(i), i != 3) for i in range(1, 6)], "s int, o int, l double, m boolean")
    assert sequences.shifted_loss(t, "s", "o", "l", F.col("m"), 2).collect()[0].loss == 4.5
    r = sequences.request_follow(spark.createDataFrame([(1, 5, "x"), (1, 9, "y")], "k int, pos int, token string"), spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "k int, segment int"), "k")
    assert sorted((x.segment, x.requested or "") for x in r.collect()) == [(0, "x"), (1, "y"), (2, "")]


def test_causality(spark):
    """Later values never change an earlier result."""
    a, b = (arrays(spark, [1, 2, 3, x, 9]).select(sequences.causal_moving_sum(F.col("v"), 3)).collect()[0][0] for x in (4, 400))
    assert a[:3] == b[:3] and a[3] != b[3]
