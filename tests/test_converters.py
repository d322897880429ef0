import math

from pyspark.sql import functions as F

from sparkloom.operators import converters as c
from sparkloom.operators import copying, generators, tracker


def test_trajectories_and_conversations(spark):
    turns = [("system", "S"), ("human", "q"), ("bot", "a"), ("tool", " ")]
    schema = "instance_id string, repo string, license string, language string, resolved int, trajectory array<struct<role:string,content:string>>, model_patch string, metadata string"
    rows = [("i1", "r", None, "python", 1, turns, " p ", '{"reference_patch": {"patch": "ref"}}'), ("i2", "r", None, "go", 1, turns, None, None), ("i3", "r", None, None, 0, turns, None, None), ("i4", "r", None, "", 1, None, None, None)]
    got = c.trajectories(spark.createDataFrame(rows, schema), source="s", languages=["python"], resolved_only=True).collect()
    assert len(got) == 1 and got[0].system == "S" and got[0].repo_context == "source: s\ninstance_id: i1\nrepo: r\nlanguage: python"
    assert [(m.role, m.content) for m in got[0].messages] == [("user", "q"), ("assistant", "a")] and [(t.type, t.content) for t in got[0].trace] == [("patch", "p"), ("patch", "ref")]
    conv = spark.createDataFrame([(True, "en", [("user", "x")]), (None, None, [("user", "x")]), (False, "fr", [("user", "x")]), (False, "English", [])], "toxic boolean, language string, conversation array<struct<role:string,content:string>>")
    assert c.conversations(conv, english_only=True).count() == 1
    assert [r.text for r in c.texts(spark.createDataFrame([(" ", "b"), (None, " ")], "content string, text string"), source="s").collect()] == ["# source: s\nb"]


def test_code_questions_count_reasons(spark):
    rows = [("python", "q", "def f():\n    return 1", 1.0, "assert f() == 1"), ("python", "q", "x = 1", 0.2, None), ("go", "q", "x", 1.0, None), (None, "", "x", 1.0, None), (None, "q", "word " * 100, 1.0, None), ("python", "q", "just words", None, "t")]
    df = spark.createDataFrame(rows, "language string, question string, solution string, average_test_score double, unit_tests string")
    out, reasons = c.code_questions(df, F.lit(7), dataset="d", least_score=0.8, need_tests=True, longest=200)
    got = out.collect()
    assert {r.reason: r.n for r in reasons.collect()} == {"kept": 2, "score": 1, "language": 1, "prompt": 1, "length": 1}
    assert {r.behavior for r in got} == {"function_completion", "code_generation"} and all(r._curriculum_source == "d:row_000007" for r in got)
    assert any(r.messages[1].content.startswith("```python") for r in got)


def test_functions_tests_and_commits(spark):
    f = spark.createDataFrame([("python", "def g(a):\n    return a", "g(a)", "doc", "x.py"), ("python", "def (", None, None, None), ("python", "x = 1", None, None, None)], "language string, func_code string, signature string, docstring string, path string")
    got = c.functions(f, F.lit(1), dataset="d", most_lines=10).collect()
    assert len(got) == 1 and "Docstring/behavior:\ndoc" in got[0].messages[0].content and got[0].repo_context == "path: x.py"
    t = spark.createDataFrame([("q", "def h():\n    return 2", "assert h() == 2"), (None, "def h():\n    return 2", "assert h() == 2"), ("q", "def h(", "x")], "question string, code_ground_truth string, tests string")
    assert sorted(r.behavior for r in c.code_with_tests(t, F.lit(1), F.col("tests"), dataset="d", longest_code=100).collect()) == ["function_completion", "pytest_generation", "pytest_generation"]
    k = spark.createDataFrame([("m", "a", "x = 1\n", "x = 2\n"), ("m", "b.py", "same", "same")], "commit_message string, path string, old_contents string, new_contents string")
    got = c.commits(k, F.lit(1), dataset="d", most_lines=20, longest=100).collect()
    assert len(got) == 1 and "--- a/a.py" in got[0].messages[1].content and "+x = 2" in got[0].messages[1].content


def test_test_shapes(spark):
    rows = ['[{"args": [1], "expected": 2}, {"input": 5, "output": 6}, {"input": [1, 2], "output": 3}, "x"]', '{"cases": [{"args": [], "raises": "ValueError"}]}', "nonsense", None]
    got = [[(t.args, t.expected, t.raises) for t in r[0]] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(c.structured_tests(F.col("t"))).collect()]
    assert got == [[("[1]", "2", None), ("[5]", "6", None), ("[1,2]", "3", None)], [("[]", None, "ValueError")], [], []]
    a = spark.createDataFrame([(["x\n  assert f(1)\nassert f(22)", None, "assert g()"],)], "s array<string>")
    assert a.select(c.assertion_lines(F.col("s"))).collect()[0][0] == ["assert f(1)", "assert f(22)", "assert g()"]
    assert a.select(c.assertion_lines(F.col("s"), chars=15)).collect()[0][0] == ["assert f(1)"]
    assert a.select(c.assertion_lines(F.col("s"), most=2)).collect()[0][0] == ["assert f(1)", "assert f(22)"]


def test_routing_and_validation(spark):
    df = spark.createDataFrame([(i, "test" if i == 0 else "train") for i in range(2000)], "id int, split string")
    got = c.route(df, "id", fraction=0.1, seed=1)
    assert got.filter("id = 0").collect()[0].dest == "eval" and 130 < got.filter("dest = 'eval'").count() < 270
    rows = [("b", "t1", "ok"), ("b", "t1", " "), ("x", "t1", "ok"), ("b", "t9", "ok"), ("b", "t1", "bad word")]
    v = c.validate(spark.createDataFrame(rows, "behavior string, topic string, final string"), behaviors=["b"], required=["t1", "t2"], anchors=["a"], forbidden=["bad"])
    assert sorted((r.problem, r.subject, r.n) for r in v.collect()) == [("behavior", "t1", 1), ("empty_final", "t1", 1), ("forbidden", "t1", 1), ("missing_anchor", "a", 0), ("missing_topic", "t2", 0), ("topic", "t9", 1)]


def brute_carry(ids, recent, reach, gap, most):
    n, out = len(ids), []
    for t in range(n):
        row = [0.0] * n
        for o in range(1, recent + 1):
            if t < o or (most and ids[: t + 1].count(ids[t - o]) > most):
                continue
            for s in range(t):
                if t - s >= gap:
                    row[s] += (recent - o + 1) * sum(s >= d and ids[s - d] == ids[t - o] for d in range(1, reach + 1))
        total = sum(row)
        out.append([x / total if total else 0.0 for x in row])
    return out


def close(a, b):
    return all(math.isclose(x, y, abs_tol=1e-9) for r, q in zip(a, b) for x, y in zip(r, q))


def test_copy_routes(spark):
    ids = [5, 1, 7, 5, 2, 7, 5, 1, 9, 5]
    df = spark.createDataFrame([(1, ids)], "seq int, ids array<int>")
    got = df.select(copying.binding_carry(F.col("ids"), 2, 2, gap=1, most=3)).collect()[0][0]
    assert close(got, brute_carry(ids, 2, 2, 1, 3))
    first, later = (df.select(x).collect()[0][0] for x in copying.key_follow(F.col("ids"), 2, gap=2, stops=(9,)))
    assert first[4] == [0.0, 1.0] + [0.0] * 8  # place 3 holds a 5, and place 1 follows the 5 at place 0
    assert first[5] == [0.0] * 10 and math.isclose(sum(first[7]), 1.0)  # position 7 follows a 5 seen before
    assert all(v == 0 for t, r in enumerate(first) for s, v in enumerate(r) if s >= t)
    again = spark.createDataFrame([(1, ids[:7] + [0, 0, 0])], "seq int, ids array<int>").select(copying.key_follow(F.col("ids"), 2, gap=2, stops=(9,))[0]).collect()[0][0]
    assert close(first[:7], again[:7])  # later tokens change nothing
    p = copying.by_token(df.withColumn("w", copying.binding_carry(F.col("ids"), 2, 2)), "seq", "ids", "w")
    assert all(math.isclose(r.p, 1.0) for r in p.groupBy("t").agg(F.sum("p").alias("p")).collect())
    c1 = df.select(copying.consistency(F.col("ids"), 1, 0, 2.0)).collect()[0][0]
    assert c1[3][0] == 2.0 and c1[3][1] == 0.0
    m = spark.range(1).select(copying.log_mix(F.lit(math.log(0.2)), F.lit(math.log(0.6)), F.lit(0.5))).collect()[0][0]
    assert math.isclose(m, math.log(0.4))


def test_sampling(spark):
    t = spark.range(4000).withColumn("l", F.array(F.lit(0.0), F.lit(math.log(3.0)), F.lit(-50.0)))
    greedy = t.select(copying.sample_token(F.col("l"), temperature=0, top=None, seed=1, key=F.col("id"))).distinct().collect()
    assert [r[0] for r in greedy] == [1]
    got = t.select(copying.sample_token(F.col("l"), temperature=1.0, top=2, seed=1, key=F.col("id")).alias("k")).groupBy("k").count().collect()
    share = {r.k: r["count"] / 4000 for r in got}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.04


def test_tracker(spark, tmp_path):
    from datetime import datetime

    t = tracker.Tracker(spark, str(tmp_path / "runs"))
    assert t.registry().count() == 0 and t.metrics().count() == 0
    t.start("a", {"lr": 1, "seed": 2}, datetime(2026, 1, 1, 0, 0, 0))
    t.update_params("a", {"lr": 3})
    t.start("b", None, datetime(2026, 1, 2))
    t.finish("a", "completed", datetime(2026, 1, 1, 0, 1, 0))
    t.add_metrics(spark.createDataFrame([("a", 1, "loss", 2.0)], "run_id string, step int, metric string, value double"))
    t.add_artifacts(spark.createDataFrame([("a", "ckpt", "p", 5), ("a", "gone", "q", None)], "run_id string, kind string, path string, size int"))
    got = t.registry().collect()
    assert [(r.run_id, r.status, r.seconds, r.params) for r in got] == [("b", "running", None, None), ("a", "completed", 60.0, {"lr": "3", "seed": "2"})]
    assert t.metrics().count() == 1 and [r.kind for r in t.artifacts().collect()] == ["ckpt"]
    nested = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', named_struct('d', 3), 'l', array(1)) AS s")
    assert tracker.flatten(nested, "eval.").columns == ["eval.a", "eval.s.b", "eval.s.c.d"]


def test_generators(spark):
    s = spark.createDataFrame([("f", 1), ("g", 2)], "name string, arity int")
    e = generators.expand(s, ["Write {name}.", "{name} takes {arity}.", "unused"], ["name", "arity"], limit=2)
    assert sorted(r.prompt for r in e.collect()) == ["Write f.", "Write g.", "f takes 1.", "g takes 2."]
    kv = generators.key_values(spark, 8, ["path", "flag"], 2, 17)
    r = kv.filter("index = 5 AND variant = 1").collect()[0]
    assert r.seed == 17 + 85 + 1009 and r.slots == {"path": "copy_path_005.py", "flag": "flag1_flag_005"} and kv.count() == 16
    f = generators.choose_fields(kv, ["a", "b", "c", "d"], 2, 1).collect()
    assert all(len(set(x.targets) | set(x.distractors)) == 3 for x in f)
    i = spark.range(4).withColumnRenamed("id", "index")
    assert sorted(x["index"] for x in generators.modes(i, 2, "ladder").collect()) == [0, 0, 1, 1, 2, 3, 4, 5]
    ctx = generators.shuffled_context(spark.createDataFrame([("t", "a"), ("t", "b")], "k string, e string"), "k", F.col("e"), 1).collect()
    assert sorted(ctx[0].context.split("\n")) == ["a", "b"]
