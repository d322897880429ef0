import json

import pytest

from sparkloom.functions import python_udfs as u
from sparkloom.sources import files, pages, sinks
from sparkloom.streaming import logs


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.jsonl").write_text('{"text": "plain"}\n\n{"messages": [{"role": "user", "content": "q"}], "final": "f"}\n')
    (tmp_path / "d/b.txt").write_text("hello\nworld")
    (tmp_path / "d/manifest.json").write_text("{}")
    (tmp_path / "d/c.bin2").write_text("no")
    return tmp_path


def test_text_and_documents(spark, folder):
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.text_files(spark, str(folder / "d")).collect()) == ["a.jsonl", "b.txt"]
    assert files.text_files(spark, str(folder / "d/c.bin2")).count() == 1
    docs = files.documents(spark, str(folder / "d")).collect()
    assert sorted(r.text for r in docs) == ["<|user|>\nq\n<|final|>\nf\n", "hello\nworld", "plain"] and all(len(r.hash) == 16 for r in docs)


def test_json_lines_policies(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "ok"}\n[1]\n{broken\n')
    assert files.json_lines(spark, str(tmp_path), on_error="drop").count() == 1
    assert sorted(r.malformed for r in files.json_lines(spark, str(tmp_path), on_error="count").collect()) == [False, True, True]
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_lines(spark, str(tmp_path)).collect()


def test_cases_and_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"prompt": "p"}, {"prompt": "q", "name": "n", "required_substrings": ["x"]}]}))
    got = files.eval_cases(spark, str(tmp_path / "c.json")).orderBy("ord").collect()
    assert [(r.name, r.required_substrings) for r in got] == [("case_000", []), ("n", ["x"])]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(Exception, match="no cases"):
        files.eval_cases(spark, str(tmp_path / "e.json")).collect()
    c = files.config_frame(spark, {"a": 5, "odd": 1, "n": {"y": 2}}, {"a": 1, "b": "x", "n": {"y": 1, "z": 3}}).collect()[0]
    assert (c.a, c.b, c.n.y, c.n.z) == (5, "x", 2, 3)


def test_binary_round_trip(spark, tmp_path):
    out = str(tmp_path / "tokens")
    sinks.write_token_parts(spark.range(1000).selectExpr("id AS pos", "id * 3 AS token"), out, 4)
    assert sinks.read_token_parts(out).tolist() == [i * 3 for i in range(1000)]
    assert files.binary_tokens(spark, out).count() == 1000


def test_run_folders_and_checkpoints(spark, tmp_path):
    for p in ("r1/train/train_log.jsonl", "r2/summary.json"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    # the folder of a step log counts as well as the one above a folder called train
    assert [r.run_dir.rsplit("/", 1)[1] for r in files.run_folders(spark, str(tmp_path)).collect()] == ["r1", "train", "r2"]
    for n in ("last", "step_100", "best", "step_50", "zz"):
        (tmp_path / f"{n}.pt").write_text("x")
    assert [r.name for r in files.checkpoints(spark, str(tmp_path)).collect()] == ["step_50", "step_100", "best", "last", "zz"]
    assert files.train_log(spark, str(tmp_path / "none.jsonl"), logs.LOG).count() == 0


def test_paging_retries():
    import urllib.error

    calls, naps = [], []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429 if len(calls) == 1 else 503, "", None, None)
        return json.dumps({"rows": [{"row_idx": 0, "row": {"a": 1}}], "num_rows_total": 250})

    assert pages.fetch("u", opener, naps.append)["num_rows_total"] == 250 and naps == [16, 2]
    with pytest.raises(urllib.error.HTTPError):
        pages.fetch("u", lambda u: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "", None, None)), naps.append)
    assert [(p.offset, p.length) for p in pages.PageReader("u", 250).partitions()] == [(0, 100), (100, 100), (200, 50)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b|x", 0.1234567, None)], "s string, v double, n string")
    assert sinks.markdown(df) == "| s | v | n |\n| --- | --- | --- |\n| b\\|x | 0.123457 |  |\n"
    sinks.write_json_lines(spark.createDataFrame([("é", 1)], "t string, _validation_case int"), str(tmp_path / "o"), drop=("_validation_case",), ascii_only=True)
    assert spark.read.text(str(tmp_path / "o")).collect()[0][0] == '{"t": "\\u00e9"}'


def test_files_are_written_by_the_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_REPORT_ROWS", 5)
    sinks.write_files(spark.range(40).selectExpr("concat('d', id % 7, '/', id, '.txt') AS name", "if(id = 3, NULL, concat('é', id)) AS text"), str(tmp_path / "o"))
    got = {p.relative_to(tmp_path / "o").as_posix(): p.read_text() for p in (tmp_path / "o").rglob("*") if p.is_file()}
    assert got == {f"d{i % 7}/{i}.txt": "" if i == 3 else f"é{i}" for i in range(40)}
    sinks.write_files(spark.createDataFrame([], "name string, text string"), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_python_functions(spark):
    t = spark.createDataFrame([("def f():\n return 1", 'x {"a": {"b": 1}} y'), ("def (", "{nope"), (None, None)], "c string, j string")
    got = t.select(u.python_syntax_ok("c"), u.first_function_name("c"), u.first_json_object("j")).collect()
    assert [tuple(r) for r in got] == [(True, "f", '{"a": {"b": 1}}'), (False, None, None), (None, None, None)]
    d = spark.createDataFrame([("p", "a\nb", "a\nc")], "p string, a string, b string").select(u.unified_diff("p", "a", "b")).collect()[0][0]
    assert d[:2] == ["--- a/p", "+++ b/p"] and "+c" in d
    run = u.test_runner(enabled=True, seconds=5)
    r = spark.createDataFrame([("def f(): return 1", "assert f() == 1"), ("def f(): return 1", "assert f() == 2")], "c string, t string").select(run("c", "t")).collect()
    assert [x[0] for x in r] == [True, False]


def test_stream_equals_batch(spark, sf_dir):
    from sparkloom.plans import catalogue

    q = catalogue.queries()
    stream, batch = q["st02"](spark, sf_dir).collect(), q["u00"](spark, sf_dir).collect()
    assert {(r.run_id, r.best, r.streak, r.scale) for r in stream} == {(r.run_id, r.best, r.streak, r.scale) for r in batch}
    assert q["st01"](spark, sf_dir).count() > 0


def test_entry(spark):
    import os

    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).columns == ["token", "id", "n"]
