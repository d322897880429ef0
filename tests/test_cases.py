"""Case scoring, loss masks, line numbers and paging on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cases, curriculum, records, tokens
from sparkloom.sources import files, pages, sinks

CASE = "completion string, required_substrings array<string>, forbidden_substrings array<string>, max_completion_chars int, expected_json string, strict_json boolean, expected_behavior string, no_trailing_text boolean, no_nonsense boolean, python_function string"


@pytest.mark.parametrize(
    ("row", "passed"),
    [
        (("```python\ndef f(x):\n    return x\n```<eos>", ["def f"], None, 100, None, None, "function_completion", True, None, "f"), True),
        (("```python\ndef f(x):\n    return x\n``` and so on", ["def f"], None, None, None, None, None, True, None, None), False),
        (("```python\ndef f(x:\n```", [], None, None, None, None, None, None, None, "f"), False),
        (('{"b": 1, "a": [2]}', None, None, None, '{"a": [2], "b": 1}', True, "json_tool_command", None, None, None), True),
        (('so {"a": 1} it is', None, None, None, '{"a": 1}', True, None, None, None, None), False),
        (('so {"a": 1} it is', None, None, None, '{"a": 1}', False, None, None, None, None), True),
        (("the campfire", None, None, None, None, None, None, None, None, None), False),
        (("the campfire", None, None, None, None, None, None, None, False, None), True),
        (("abc", ["x"], None, None, None, None, None, None, None, None), False),
        (("abc", None, ["b"], None, None, None, None, None, None, None), False),
        (("abcdef", None, None, 3, None, None, None, None, None, None), False),
        (("abcdef", None, None, 0, None, None, "patch_addition", None, None, None), False),
        ((None, None, None, None, None, None, None, None, None, None), True),
    ],
)
def test_ladder_rules(spark, row, passed):
    assert cases.score_ladder(spark.createDataFrame([row], CASE), "completion").collect()[0].passed is passed


def test_tests_run_only_when_asked(spark):
    df = spark.createDataFrame([("def f(x):\n    return x + 1", ["assert f(1) == 2"]), ("def f(x):\n    return x", ["assert f(1) == 2"])], "completion string, python_assert_tests array<string>")
    assert [r.passed for r in cases.score_ladder(df, "completion").collect()] == [True, True]
    assert [r.passed for r in cases.score_ladder(df, "completion", run_tests=True).collect()] == [True, False]


def test_slot_errors(spark):
    rows = [("k = a\nj=b<eos>", {"k": "a", "j": "b"}, None, True), ("j=b\nk=a", {"k": "a", "j": "b"}, None, True), ("k=x\nj=b", {"k": "a", "j": "b"}, "copy_key_sequence", True), ("k\nother\nj", {"k": "a", "j": "b"}, None, False), (None, None, None, None)]
    df = spark.createDataFrame(rows, "completion string, expected_slots map<string,string>, expected_behavior string, enforce_value_sequence boolean")
    # a Python dictionary loses its order on the way into a map
    df = df.withColumn("expected_key_sequence", F.when(F.col("expected_slots").isNotNull(), F.array(F.lit("k"), F.lit("j"))))
    got = [(r.keys_correct, r.values_correct, r.passed, r.slot_error) for r in cases.score_slots(df, "completion").collect()]
    assert got == [(True, True, True, False), (False, False, False, False), (True, False, False, True), (True, None, True, False), (None, None, True, False)]
    assert cases.score_slots(df.limit(0), "completion").count() == 0


def test_patch_and_boundaries(spark):
    t = spark.range(1).select(
        cases.value_sequence(F.lit("a=<value> x </value>\n<value>y\nz</value>")).alias("v"), cases.patch_failures(F.lit("```diff\n--- a/f\n+++ b/f\n@@\n-x\n+y"), F.struct(F.lit("f").alias("path"), F.lit("x\n").alias("removed"), F.lit("y").alias("added"))).alias("p"),
        cases.patch_failures(F.lit("x"), F.lit(None).cast("struct<path:string,removed:string,added:string>")).alias("none"),
    ).collect()[0]
    assert t.v == ["x", "<value>y", "z</value>"] and t.p == [] and t.none is None


def test_loss_mask_equals_characters(spark):
    """Token by token the same as marking every character of the rendering."""
    import re

    messages = [("user", "Fix  it \n"), ("assistant", "Done: x == 1.5\n\n"), (None, None), ("odd role", "é漢")]
    trace = [("tool_call", "run"), ("tool_result", "ok  "), ("patch", ""), (None, "so")]
    rows = [(1, "S", None, messages, trace, "final  \n ", None), (2, None, "", None, None, None, "  plain text "), (3, None, None, [], [], "", None)]
    df = spark.createDataFrame(rows, "id int, system string, repo_context string, messages array<struct<role:string,content:string>>, trace array<struct<type:string,content:string>>, final string, text string")
    got = {r.id: [(m.token, m.own) for m in r.m] for r in df.select("id", tokens.loss_mask(records.loss_pieces()).alias("m")).collect()}
    pieces = [("<|system|>\nS\n", 0)] + [(f"<|{r or 'user'}|>\n{c or ''}\n", int(r == "assistant")) for r, c in messages]
    pieces += [("<|tool|>\nrun\n", 1), ("<|tool_result|>\nok  \n", 0), ("<|patch|>\n\n", 1), ("<|assistant|>\nso\n", 1), ("<|final|>\nfinal  \n \n", 1)]
    text = "\n".join(p for p, _ in pieces)
    mask = []
    for i, (p, own) in enumerate(pieces):
        mask += ([0] if i else []) + [own] * len(p)
    end = len(text.rstrip())
    text, mask = text[:end] + "\n", mask[:end] + [mask[end - 1]]
    want = [(m.group(), any(mask[m.start() : m.end()])) for m in re.finditer(tokens.LEXER, text, re.A)]
    assert got[1] == want
    assert "".join(t for t, _ in got[2]) == "plain text\n" and all(o for _, o in got[2]) and got[3] == []


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [json.dumps({"text": f"t{i}"}) if i % 5 else "" for i in range(1, 2001)]
    (tmp_path / "a.JSONL").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        got = [(r.line, r.text) for r in files.json_lines(spark, str(tmp_path)).select("line", "text").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(got) == [(i, f"t{i}") for i in range(1, 2001) if i % 5]


def test_paging_without_a_total(monkeypatch):
    def fetch(url):
        offset, length = (int(p.split("=")[1]) for p in url.split("&")[1:])
        return {"rows": [{"row_idx": i, "row": {"v": i}} for i in range(offset, min(250, offset + length))]}

    monkeypatch.setattr(pages, "fetch", fetch)
    reader = pages.PageReader("http://host/rows?x", None)
    parts = reader.partitions()
    assert len(parts) == 1 and [i for i, _ in reader.read(parts[0])] == list(range(250))
    assert [i for p in pages.PageReader("http://host/rows?x", 250).partitions() for i, _ in reader.read(p)] == list(range(250))


def test_reports_are_never_cut(spark, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_REPORT_ROWS", 2)
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(3))


def test_dependent_settings():
    defaults = {"n_heads": 4, "n_kv_heads": None, "use_curriculum_mtp": True, "mtp": {"enabled": True, "n": 2}}
    assert files.resolve_config({"n_heads": 8, "use_curriculum_mtp": False, "x": 1, "mtp": {"n": 3}}, defaults) == {"n_heads": 8, "n_kv_heads": 8, "use_curriculum_mtp": False, "mtp": {"enabled": False, "n": 3}}


def test_overlap_of_nulls_and_clashing_names(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), ("y", 4)], "text string, key int")
    b = spark.createDataFrame([("x", 9), (None, 9), ("x", 9)], "text string, key int")
    assert [r.text for r in curriculum.overlap(a, b, "text").collect()] == ["x"]
    assert sorted((r.text or "", r.key) for r in curriculum.disjoint(a, b, "text").collect()) == [("", 3), ("y", 4)]


def test_patches_apply_as_difflib_made_them():
    import difflib
    import random

    from sparkloom.functions.python_udfs import applies

    r = random.Random(4)
    for _ in range(60):
        old = [r.choice("abcdef") * r.randint(0, 3) for _ in range(r.randint(1, 40))]
        new = [x for x in old if r.random() > 0.1] + ["tail"]
        patch = "\n".join(difflib.unified_diff(old, new, "a/f", "b/f", lineterm=""))
        text = "\n".join(old) + "\n"
        assert applies(patch, {"f": text}) and not applies(patch, {"g": text})
        assert not applies(patch.replace("+tail", ""), {"f": text})
    assert not applies("", {"f": ""}) and not applies("no patch", {"f": "x"})
