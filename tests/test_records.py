from pyspark.sql import functions as F

from sparkloom.functions.cleaning import clean_language, source_family, source_origin
from sparkloom.functions.text import count_of, extract_fenced, first_text, key_values, line_count, missing, preview
from sparkloom.operators import records

RECORD = "record_id bigint, system string, repo_context string, messages array<struct<role:string,content:string>>, trace array<struct<type:string,content:string>>, final string, text string"


def one(df):
    return df.collect()[0]


def test_roles(spark):
    given = ["prompter", " Human ", "", None, "system", "Observation", "function", "bot", "assistant", "tool"]
    t = spark.createDataFrame([(x,) for x in given], "r string").select(records.normalize_role(F.col("r")))
    assert [r[0] for r in t.collect()] == ["user", "user", "user", "user", "system", "tool_result", "tool_result", "assistant", "assistant", "tool_result"]


def test_render_in_order(spark):
    t = spark.createDataFrame([(1, "S", "R", [("user", "hi"), ("assistant", " "), ("environment", "out")], [("tool_call", "ls"), ("odd", "x"), ("patch", "p")], "F", None)], RECORD)
    assert one(t.select(records.render()))[0] == "<|system|>\nS\n<|repo_context|>\nR\n<|user|>\nhi\n<|tool_result|>\nout\n<|tool|>\nls\n<|assistant|>\nx\n<|patch|>\np\n<|final|>\nF\n"
    assert one(t.select(records.render_plain()))[0] == "S\nR\nhi\nout\nls\nx\np\nF"


def test_plain_and_empty_records(spark):
    t = spark.createDataFrame([(1, None, None, None, None, None, "just text"), (2, None, None, None, None, None, None)], RECORD)
    assert [r[0] for r in t.select(records.render()).collect()] == ["just text", "\n"]
    assert [r[0] for r in t.select(records.is_structured(t)).collect()] == [False, False]


def test_reply_pairs(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (2, 0, "assistant", "lost"), (2, 1, "user", "e")]
    t = records.reply_pairs(spark.createDataFrame(turns, "k int, pos int, role string, text string"), "k", "pos")
    assert sorted(map(tuple, t.collect())) == [(1, 1, "b", 2, "c"), (1, 1, "b", 3, "d")]


def test_threads_keep_order_and_filters(spark):
    rows = [("u1", None, "prompter", "old", 1, False), ("u1", None, "prompter", "new", 2, False), ("a1", "u1", "assistant", "yes", 3, False), ("a2", "u2", "assistant", "early", 4, False), ("u2", None, "prompter", "late", 5, False), ("u3", None, "prompter", "gone", 6, True), ("a3", "u3", "assistant", "no", 7, False)]
    t = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string, ord int, deleted boolean")
    assert [tuple(r) for r in records.threaded_pairs(t, ~F.col("deleted")).collect()] == [("u1", "a1", "new", "yes")]


def test_status_falls_through_and_missing_scores_pass(spark):
    t = spark.createDataFrame([(False, True, "0.9"), (False, None, None), (None, False, "x"), (True, False, "0.1"), (None, None, "NaN")], "p boolean, e boolean, s string")
    got = t.select(records.status_or_fallback(F.col("p"), F.col("e")), records.score_passes(0.5, F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (None, True), (False, True), (True, False), (None, True)]


def test_snippet_choice(spark):
    t = spark.createDataFrame([([("long code here", 0.0, 0.0), ("bb", 0.1, 0.1), ("aa", 0.1, 0.1)],), ([],), ([("toolong", None, None)],)], "t array<struct<code:string,far:double,frr:double>>")
    assert [r[0] for r in t.select(records.code_test_snippet(F.col("t"), 5)).collect()] == ["aa", "", ""]


def test_labels(spark):
    t = spark.createDataFrame([(" EN",), ("de_DE",), ("spanish",), ("es-419",), (None,), ("  ",), ("xx",)], "l string")
    assert [r[0] for r in t.select(clean_language(F.col("l"))).collect()] == ["en", "de", "es", "es", "unknown", "unknown", "xx"]
    t = spark.createDataFrame([("Tool-Chat :7",), ("raw/patch_pairs/gate-3.jsonl:9",), (None,), (" ",), ("LADDER:x:1",)], "s string")
    assert [r[0] for r in t.select(source_origin(F.col("s"))).collect()] == ["tool_chat", "patch_pairs", "unknown", "unknown", "ladder"]
    assert [r[0] for r in t.select(source_family(F.col("s"))).collect()] == ["tool-chat", "raw/patch_pairs/gate-3.jsonl", None, None, "ladder"]


def test_text_functions(spark):
    t = spark.createDataFrame([("a=1\n\n b = x=y \nnone", "```python\ncode\n```", " x ", None)], "kv string, f string, s string, n string")
    r = one(t.select(key_values(F.col("kv")), line_count(F.col("kv")), extract_fenced(F.col("f")), first_text(F.col("n"), F.col("s")), preview(F.lit("aa  bb\ncc"), 6), count_of(F.lit("<|a<|"), "<|"), missing(F.col("n"), F.array(F.lit("q")))))
    assert [tuple(p) for p in r[0]] == [("a", "1"), ("b", "x=y")]
    assert tuple(r)[1:] == (3, "code\n", "x", "aa ...", 2, ["q"])
