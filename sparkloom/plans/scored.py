"""Queries g01 to g10: case scoring, loss masks, evaluation cases and run names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import cases, converters, records, runlog, tokens
from sparkloom.plans.corpus import VOCAB, _ALLVOCAB, big, vocabulary
from sparkloom.plans.registry import query
from sparkloom.tables import load, spread

_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\x{0b}\f\r\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rules(rules, low: str = "low") -> str:
    any_of = lambda ns: "(" + " OR ".join(f"contains({low}, {_quoted(n)})" for n in ns) + ")"
    return "CASE " + " ".join(f"WHEN {' AND '.join(map(any_of, lists))} THEN '{label}'" for label, lists in rules) + " ELSE 'unknown' END"


REQUIRED, FORBIDDEN, LONGEST = ["return", "def "], ["assert", "TODO"], 400
_LIST = lambda xs: "[" + ", ".join(map(_quoted, xs)) + "]"
_SAID = f"""SELECT DISTINCT record_id, c, {_strip("replace(replace(c, '<eos>', ''), '<bos>', '')")} AS t FROM (SELECT record_id, coalesce(array_to_string(list_transform(trace, lambda x: x.content), chr(10)), '') AS c FROM agentcoder_slice_train)"""
_TAIL = lambda m: f"CASE WHEN instr(substr(t, instr(t, '{m}') + {len(m)}), '```') > 0 THEN {_strip(f'''substr(substr(t, instr(t, '{m}') + {len(m)}), instr(substr(t, instr(t, '{m}') + {len(m)}), '```') + 3)''')} ELSE '' END"
_SCORED = f"""SELECT record_id, list_filter({_LIST(REQUIRED)}, lambda n: NOT contains(c, n)) AS missing, list_filter({_LIST(FORBIDDEN)}, lambda n: contains(c, n)) AS forbidden, length(t) > {LONGEST} AS too_long,
 list_concat(list_filter({_LIST(cases.BAD_PHRASES)}, lambda p: contains(lower(t), p)), CASE WHEN contains(lower(t), '<|user|>') OR contains(lower(t), '<|assistant|>') OR contains(lower(t), '<|system|>') THEN ['{cases.MARKER_HIT}'] ELSE [] END) AS hits,
 CASE WHEN contains(t, '```python') THEN {_TAIL('```python')} WHEN contains(t, '```') THEN {_TAIL('```')} ELSE '' END AS tail FROM ({_SAID})"""


def _said(s, d):
    t = load(s, d, "agentcoder_slice_train").select("record_id", F.coalesce(F.array_join("trace.content", "\n"), F.lit("")).alias("completion")).distinct()
    return spread(t)


@query("g01", f"""
SELECT record_id, array_to_string(missing, '|') AS missing, array_to_string(forbidden, '|') AS forbidden, too_long, array_to_string(hits, '|') AS hits, length(tail)::BIGINT AS tail,
 len(missing) = 0 AND len(forbidden) = 0 AND NOT too_long AND len(hits) = 0 AND tail = '' AS passed FROM ({_SCORED})""")  # fmt: skip
def g01(s, d):
    """Every record's steps scored against one case: substrings, length, nonsense and what follows the code."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    t = _said(s, d).withColumns({"required_substrings": lit(REQUIRED), "forbidden_substrings": lit(FORBIDDEN), "max_completion_chars": F.lit(LONGEST), "no_trailing_text": F.lit(True)})
    r = cases.score_ladder(t, "completion")
    return r.select("record_id", F.array_join("missing_required", "|").alias("missing"), F.array_join("present_forbidden", "|").alias("forbidden"), F.coalesce("too_long", F.lit(False)).alias("too_long"), F.array_join("nonsense_hits", "|").alias("hits"), big(F.length("trailing_text")).alias("tail"), "passed")


@query("g02", f"""
SELECT ladder, curated, count(*)::BIGINT AS n FROM (SELECT {_rules(cases.LADDER_RULES)} AS ladder, {_rules(cases.CURATED_RULES)} AS curated FROM (SELECT lower(c) AS low FROM ({_SAID}))) GROUP BY 1, 2""")  # fmt: skip
def g02(s, d):
    """Records by the classes of both rule tables."""
    t = _said(s, d).select(cases.rule_label(F.col("completion"), cases.LADDER_RULES).alias("ladder"), cases.rule_label(F.col("completion"), cases.CURATED_RULES).alias("curated"))
    return t.groupBy("ladder", "curated").agg(F.count(F.lit(1)).alias("n"))


_LINES = f"list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), '<eos>', chr(10)), '{_BREAK}'), lambda x: {_strip('x')}), lambda x: x <> '')"
_KEYS = f"list_filter(list_transform({_LINES}, lambda x: {_strip('''string_split(x, '=')[1]''')}), lambda k: k <> '')"
_VALUES = f"list_filter(list_transform({_LINES}, lambda x: {_strip('''regexp_replace(x, '^[^=]*=', '')''')}), lambda v: v <> '')"


@query("g03", f"SELECT doc_id, len({_KEYS})::BIGINT AS n_keys, substr(sha256(array_to_string({_KEYS}, '|')), 1, 16) AS keys, substr(sha256(array_to_string({_VALUES}, '|')), 1, 16) AS vals FROM documents")
def g03(s, d):
    """Key and value sequences of each document's lines."""
    k, v = cases.key_sequence(F.col("text")), cases.value_sequence(F.col("text"), "\u0001", "\u0001")
    digest = lambda c: F.substring(F.sha2(F.array_join(c, "|").cast("binary"), 256), 1, 16)
    return spread(load(s, d, "documents")).select("doc_id", big(F.size(k)).alias("n_keys"), digest(k).alias("keys"), digest(v).alias("vals"))


_PIECE = lambda tag, c, own: f"CASE WHEN coalesce({c}, '') <> '' THEN [{{'b': '<|{tag}|>' || chr(10) || {c} || chr(10), 'o': {own}}}] ELSE [] END"
_PIECES = f"""CASE WHEN text IS NOT NULL THEN [{{'b': regexp_replace(text, '^{_BLANK}+', ''), 'o': TRUE}}] ELSE list_concat(list_concat(list_concat(list_concat({_PIECE('system', 'system', 'FALSE')}, {_PIECE('repo_context', 'repo_context', 'FALSE')}),
 coalesce(list_transform(messages, lambda m: {{'b': '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || coalesce(m.content, '') || chr(10), 'o': coalesce(m.role, 'user') = 'assistant'}}), [])),
 coalesce(list_transform(trace, lambda x: {{'b': '<|' || CASE x.type WHEN 'tool_call' THEN 'tool' WHEN 'tool_result' THEN 'tool_result' WHEN 'patch' THEN 'patch' WHEN 'test_output' THEN 'test_output' ELSE 'assistant' END || '|>' || chr(10) || coalesce(x.content, '') || chr(10), 'o': coalesce(x.type NOT IN ('tool_result', 'test_output'), TRUE)}}), [])),
 {_PIECE('final', 'final', 'TRUE')}) END"""


@query("g04", f"""
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY i, j) - 1)::BIGINT AS pos, token, own FROM
 (SELECT record_id, i, o AS own, unnest(tt) AS token, generate_subscripts(tt, 1) AS j FROM (SELECT record_id, i, p.o AS o, regexp_extract_all(CASE WHEN i < n THEN p.b || chr(10) ELSE regexp_replace(p.b, '{_BLANK}+$', '') || chr(10) END, '{tokens.LEXER}', 0) AS tt FROM
 (SELECT record_id, len(ps) AS n, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT DISTINCT record_id, {_PIECES} AS ps FROM agentcoder_coding_ladder_sft_text))))""".replace(
    "FROM agentcoder_coding_ladder_sft_text", "FROM (SELECT *, NULL::VARCHAR AS text FROM agentcoder_coding_ladder_sft)"))
def g04(s, d):
    """Every token of each ladder record with whether the model is scored on it."""
    t = load(s, d, "agentcoder_coding_ladder_sft").withColumn("text", F.lit(None).cast("string"))
    t = spread(t.select("record_id", records.loss_pieces().alias("pieces")).distinct())
    m = t.select("record_id", F.posexplode(tokens.loss_mask(F.col("pieces"))).alias("pos", "m"))
    return m.select("record_id", big("pos").alias("pos"), "m.token", "m.own")


@query("g05", f"SELECT token, id FROM ({_ALLVOCAB}) WHERE token IN ({', '.join(_quoted(t) for t in tokens.SPECIALS if t != '<eos>')})")
def g05(s, d):
    """Ids that are never sampled inside a text."""
    return tokens.suppressed_ids(tokens.with_specials(vocabulary(s, d)))


@query("g06", """
SELECT run_id, coalesce(nullif(params['model_name'], ''), CASE @ ELSE 'unknown' END) AS model,
 'backfill-' || substr(regexp_replace(regexp_replace(lower(run_id || ' ' || coalesce(params['mixer'], '')), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) || '-' || substr(sha1('runs/' || run_id || ' ' || coalesce(params['mixer'], '')), 1, 12) AS stable_id
 FROM (SELECT DISTINCT run_id, params, lower(run_id || ' ' || coalesce(params['mixer'], '')) AS p FROM run_registry WHERE run_id IS NOT NULL)""".replace("@", " ".join(f"WHEN contains(p, '{w}') THEN '{k}'" for w, k in runlog.MODEL_WORDS)))  # fmt: skip
def g06(s, d):
    """Model and stable id of every run folder."""
    t = load(s, d, "run_registry").filter("run_id IS NOT NULL").select("run_id", "params", F.concat(F.lit("runs/"), "run_id", F.lit(" "), F.coalesce(F.try_element_at("params", F.lit("mixer")), F.lit(""))).alias("path"))
    t = t.select("run_id", F.to_json("params").alias("j"), runlog.infer_model_name(F.col("path"), F.col("params")).alias("model"), runlog.stable_run_id(F.col("path"), "backfill").alias("stable_id"))
    return t.distinct().select("run_id", "model", "stable_id")


_R = "list_distinct(required_substrings)"


@query("g07", """
SELECT item_id, (item_id % 3 = 0 OR (item_id % 3 = 1 AND list_reverse(k) = k)) AS keys_correct, (item_id % 3 = 0 OR (item_id % 3 = 1 AND list_reverse(k) = k)) AS values_correct,
 (item_id % 3 = 0 OR (item_id % 3 = 1 AND list_reverse(k) = k)) AS passed FROM (SELECT item_id, list_sort(list_distinct(required_substrings)) AS k FROM benchmark WHERE len(required_substrings) > 0)""")  # fmt: skip
def g07(s, d):
    """Copied slots in order, in reverse, and without the last one."""
    keys = F.array_sort(F.array_distinct("required_substrings"))
    t = load(s, d, "benchmark").filter(F.size("required_substrings") > 0).select("item_id", keys.alias("k"))
    value = lambda k: F.concat(F.lit("<value>"), F.upper(k), F.lit("</value>"))
    order = F.when(F.col("item_id") % 3 == 0, F.col("k")).when(F.col("item_id") % 3 == 1, F.reverse("k")).otherwise(F.slice("k", 1, F.size("k") - 1))
    t = t.withColumns({"completion": F.concat(F.array_join(F.transform(order, lambda k: F.concat(k, F.lit(" = "), value(k))), "\n"), F.lit("<eos>")), "expected_slots": F.map_from_arrays("k", F.transform("k", lambda k: F.upper(k))), "enforce_value_sequence": F.lit(True)})
    return cases.score_slots(t, "completion").select("item_id", "keys_correct", "values_correct", "passed")


@query("g08", """
SELECT item_id, array_to_string(list_filter([CASE WHEN item_id % 4 = 1 THEN 'missing patch marker --- a/' || item_id || '.py' END, CASE WHEN item_id % 4 = 2 THEN 'missing patch marker +new ' || item_id END, CASE WHEN item_id % 4 = 3 THEN 'missing diff fence' END, CASE WHEN item_id % 4 = 3 THEN 'missing hunk marker' END], lambda x: x IS NOT NULL), '|') AS failures FROM benchmark""")  # fmt: skip
def g08(s, d):
    """What patches lack: headers, lines, fence or hunk."""
    n, mode = F.col("item_id").cast("string"), F.col("item_id") % 4
    part = lambda bad, text: F.when(mode == bad, "").otherwise(text)
    completion = F.concat(part(3, F.lit("```diff\n")), part(1, F.concat(F.lit("--- a/"), n, F.lit(".py\n"))), F.concat(F.lit("+++ b/"), n, F.lit(".py\n")), part(3, F.lit("@@ -1 +1 @@\n")), F.concat(F.lit("-old "), n, F.lit("\n")), part(2, F.concat(F.lit("+new "), n, F.lit("\n"))))
    expected = F.struct(F.concat(n, F.lit(".py")).alias("path"), F.concat(F.lit("old "), n, F.lit("\n")).alias("removed"), F.concat(F.lit("new "), n).alias("added"))
    return load(s, d, "benchmark").select("item_id", F.array_join(cases.patch_failures(completion, expected), "|").alias("failures"))


@query("g09", """
SELECT 'parts:' || p_partkey AS name, '<|user|>' || chr(10) || p_name || chr(10) || '<|assistant|>' || chr(10) AS prompt, CASE WHEN p_partkey % 3 = 0 THEN '{"name": "f", "tests": [{"args": [' || p_size || '], "kwargs": {}, "expected": ' || p_partkey || '}, {"args": [], "kwargs": {}, "raises": "ValueError"}]}' END AS tests,
 CASE WHEN p_partkey % 3 = 1 THEN 'assert f(1) == ' || p_size || '|assert f(2)' END AS asserts FROM part WHERE p_partkey % 3 < 2""")  # fmt: skip
def g09(s, d):
    """Executable evaluation cases of rows with tests of two shapes; rows without tests give none."""
    t = load(s, d, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    payload = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"tests": [{"args": ['), size, F.lit('], "expected": '), key, F.lit('}, {"args": [], "raises": "ValueError"}, "noise"]}')))
    snippets = F.when(F.col("p_partkey") % 3 == 1, F.array(F.concat(F.lit("x = 1\n  assert f(1) == "), size), F.lit("assert f(2)\ny = 2"))).otherwise(F.array().cast("array<string>"))
    c = cases.eval_cases_from_tests(t, "p_partkey", F.col("p_name"), F.lit("def f(x):\n    return x"), converters.structured_tests(payload), converters.assertion_lines(snippets), F.lit("f"), dataset="parts", longest=100)
    return c.select("name", "prompt", F.col("python_function").alias("tests"), F.array_join("python_assert_tests", "|").alias("asserts"))


@query("g10")
def g10(s, d):
    """Every rule of the coding cases on records that say what they should do, syntax and JSON among them."""
    t = load(s, d, "agentcoder_slice_train").groupBy("record_id").agg(F.max(F.coalesce(F.array_join("trace.content", "\n"), F.lit(""))).alias("completion"))
    t = spread(t).withColumns({"python_syntax": F.contains("completion", F.lit("def ")), "expected_json": F.lit('{"cmd": "pytest"}'), "no_nonsense": F.lit(False)})
    r = cases.score_ladder(t, "completion")
    return r.select("record_id", "syntax_ok", "json_ok", "predicted_behavior", "passed")
