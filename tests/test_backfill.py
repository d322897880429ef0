from sparkloom.operators import backfill


def nested(depth):
    v = 1
    for _ in range(depth):
        v = f'{{"k": {v}, "e": {{}}, "l": [1]}}'
    return v


def test_flattened_json(spark):
    rows = [(1, '{"a": {"b": null, "c": {"d": true}}, "e": "x", "l": [{"m": 1}], "o": {}}'), (2, "[1]"), (3, "3"), (4, "{"), (5, None), (6, "{}"), (7, nested(backfill.DEPTH)), (8, nested(backfill.DEPTH + 1))]
    t = backfill.flatten_json(spark.createDataFrame(rows, "k int, v string"), ["k"], "v")
    assert sorted(map(tuple, t.collect())) == [(1, "a.b", None), (1, "a.c.d", "true"), (1, "e", "x"), (7, ".".join("k" * backfill.DEPTH), "1")]


def test_files_of_runs_are_read_once(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"r{n}").mkdir()
        (tmp_path / f"r{n}/summary.json").write_text('{"a": {"b": %d}}' % n)
    p = backfill.parameters(spark, str(tmp_path))
    assert sorted(r.params["summary.a.b"] for r in p.collect()) == ["0", "1", "2"]
    assert p._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
