"""Scoring a completion against an evaluation case: every rule a column, and whether all that apply hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.python_udfs import canonical_json, json_value, python_syntax_ok, test_runner
from sparkloom.functions.text import missing, strip

#: Phrases that show a completion has lost its thread.
BAD_PHRASES = [
    "abyssal",
    "ai language model",
    "cahoon",
    "campfire",
    "carrots",
    "colonial",
    "communicationservice",
    "compromising",
    "nanana",
    "now, we can",
    "postwrest",
    "stamina",
    "subservient",
]
CHAT_MARKERS = ["<|user|>", "<|assistant|>", "<|system|>"]
MARKER_HIT = "chat marker repetition"
#: Labels of the ladder's classes, in order, with what the text in lower case must hold: any of each list.
_DIFF = ["```diff", "--- a/", "+++ b/"]
LADDER_RULES = [
    ("patch_safe_int_default", [_DIFF, ["safe_int", "parsers.py"]]),
    ("patch_parse_port_range", [_DIFF, ["parse_port", "config.py"]]),
    ("patch_off_by_one", [_DIFF, ["limit + 1", "first_items"]]),
    ("patch_boolean_flag", [_DIFF, ["== 'true'", "is_enabled"]]),
    ("patch_addition", [_DIFF]),
    ("pytest_generation", [["def test_"], ["assert "]]),
    ("function_completion", [["def "]]),
]
#: The same of the classes of the curated cases.
COPY_MARKERS = [
    "symbol=",
    "file=",
    "helper=",
    "return=",
    "literal=",
    "test=",
    "module=",
    "route=",
    "fixture=",
    "setting=",
    "adapter=",
    "service=",
    "endpoint=",
    "task=",
    "parser=",
]
CURATED_RULES = [
    ("copy_slot_values", [COPY_MARKERS]),
    ("patch_boolean_flag", [_DIFF, ["is_enabled", "feature", "flag", "== 'true'", '== "true"', "enabled value"]]),
    ("patch_addition", [_DIFF]),
    ("risky_clarifying_question", [["which file"], ["rollback", "test command", "test"]]),
    ("test_command", [["python -m pytest -q"]]),
    ("test_command", [["pytest"], ["run"]]),
    ("function_completion", [["```python"], ["def "]]),
    ("function_completion", [["def is_even", "def is_odd", "return n % 2"]]),
    ("repo_context_lookup", [["implemented in"]]),
    ("plain_debugging", [["reproduce"], ["assertion", "smallest"]]),
    ("code_review", [["65535"]]),
    ("code_review", [["numeric"], ["port"]]),
    ("stack_trace_diagnosis", [["valueerror", "int()", "validate before conversion", "keyerror", "filenotfounderror"]]),
    ("commit_summary", [["commit"], ["summary", "message"]]),
]


def strip_special(c: Column) -> Column:
    """c without begin and end markers and outer white space."""
    return strip(F.replace(F.replace(c, F.lit("<eos>"), F.lit("")), F.lit("<bos>"), F.lit("")))


def _any(low: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def nonsense_hits(c: Column) -> Column:
    """ARRAY of the bad phrases in the text in lower case, and a mark for chat markers; empty for null."""
    low = F.lower(strip_special(F.coalesce(c, F.lit(""))))
    phrases = F.filter(F.array(*map(F.lit, BAD_PHRASES)), lambda p: F.contains(low, p))
    return F.concat(phrases, F.when(_any(low, CHAT_MARKERS), F.array(F.lit(MARKER_HIT))).otherwise(F.array().cast("array<string>")))


def rule_label(c: Column, rules: list[tuple[str, list[list[str]]]], default: str = "unknown") -> Column:
    """Label of the first rule whose lists all have a member in the text in lower case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(default)
    for label, lists in reversed(rules):
        holds = F.lit(True)
        for needles in lists:
            holds = holds & _any(low, needles)
        out = F.when(holds, label).otherwise(out)
    return out


def python_code(c: Column) -> tuple[Column, Column]:
    """(code, what follows it): of the first python fence, else the first fence, else from the first def, else all of the text."""
    text = strip_special(F.coalesce(c, F.lit("")))
    fence = "```"

    def after(mark: str) -> Column:
        return F.substr(text, F.instr(text, F.lit(mark)) + len(mark))

    def cut(mark: str) -> tuple[Column, Column]:
        rest = after(mark)
        at = F.instr(rest, F.lit(fence))
        return strip(F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest)), strip(F.when(at > 0, F.substr(rest, at + 3)).otherwise(F.lit("")))

    (a, b), (x, y) = cut(fence + "python"), cut(fence)
    has = lambda m: F.contains(text, F.lit(m))
    code = F.when(has(fence + "python"), a).when(has(fence), x).when(has("def "), strip(F.substr(text, F.instr(text, F.lit("def "))))).otherwise(text)
    return code, F.when(has(fence + "python"), b).when(has(fence), y).otherwise(F.lit(""))


def patch_failures(c: Column, expected: Column) -> Column:
    """ARRAY of what a patch lacks of STRUCT<path, removed, added>: headers, lines, fence and hunk; null where nothing is expected."""
    text = F.coalesce(c, F.lit(""))
    lines = lambda x, sign: F.transform(F.filter(F.split(F.regexp_replace(x, r"\R\z", ""), r"\R"), lambda _: x != ""), lambda v: F.concat(F.lit(sign), v))
    needles = F.concat(F.array(F.concat(F.lit("--- a/"), expected["path"]), F.concat(F.lit("+++ b/"), expected["path"])), lines(expected["removed"], "-"), lines(expected["added"], "+"))
    out = F.concat(F.transform(missing(text, needles), lambda n: F.concat(F.lit("missing patch marker "), n)), F.array_compact(F.array(F.when(~F.contains(text, F.lit("```diff")), "missing diff fence"), F.when(~F.contains(text, F.lit("@@")), "missing hunk marker"))))
    return F.when(expected.isNotNull(), out)


def _lines(c: Column) -> Column:
    found = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("<eos>"), F.lit("\n")), r"\R"), lambda x: strip(x))
    return F.filter(found, lambda x: x != "")


def key_sequence(c: Column, allowed: Column | None = None) -> Column:
    """Keys of a completion's lines, in order: what stands before the first '=', or the line; only allowed ones where some are named."""
    keys = F.filter(F.transform(_lines(c), lambda x: strip(F.substring_index(x, "=", 1))), lambda k: k != "")
    if allowed is None:
        return keys
    return F.filter(keys, lambda k: allowed.isNull() | (F.size(allowed) == 0) | F.array_contains(allowed, k))


def value_sequence(c: Column, opening: str = "<value>", closing: str = "</value>") -> Column:
    """Values of a completion's lines, in order: what stands behind the first '=', or the line, without boundary tags."""

    def value(x: Column) -> Column:
        v = strip(F.regexp_replace(x, r"^[^=]*=", ""))
        inner = F.substr(v, F.lit(len(opening) + 1), F.greatest(F.lit(0), F.length(v) - len(opening) - len(closing)))
        return F.when(v.startswith(opening) & v.endswith(closing), strip(inner)).otherwise(v)

    return F.filter(F.transform(_lines(c), value), lambda v: v != "")


def expected_keys(stated: Column, targets: Column, slots: Column) -> Column:
    """The expected keys: stated ones, else the targets, else the keys of the slots."""
    return F.coalesce(stated, targets, F.map_keys(slots))


def expected_values(stated: Column, keys: Column, slots: Column) -> Column:
    """The expected values: stated ones, else those of the keys that have a slot."""
    there = F.filter(keys, lambda k: F.map_contains_key(slots, k))
    return F.coalesce(stated, F.transform(there, lambda k: F.try_element_at(slots, k)))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def score_ladder(df: DataFrame, completion: str, *, run_tests: bool = False) -> DataFrame:
    """df with the columns of every rule of the coding cases and ``passed``, which rules that don't apply leave alone.

    Rules: required and forbidden substrings, the length cap (none where it is
    null or 0), nonsense (unless no_nonsense is false), Python syntax (where
    the case names a function, tests or syntax), tests (only with run_tests;
    else null), JSON equality, strict or embedded, the patch, no text behind
    the code, and the behaviour. A null completion is an empty one. Case
    columns that df lacks count as null.
    """
    c = F.coalesce(F.col(completion), F.lit(""))
    get = lambda n, k="string": _column(df, n, k)
    code, tail = python_code(c)
    asks_code = get("python_function").isNotNull() | get("python_assert_tests", "array<string>").isNotNull() | F.coalesce(get("python_syntax", "boolean"), F.lit(False))
    out = df.withColumns({
        "missing_required": missing(c, get("required_substrings", "array<string>")),
        "present_forbidden": F.filter(F.coalesce(get("forbidden_substrings", "array<string>"), F.array().cast("array<string>")), lambda n: F.contains(c, n)),
        "too_long": (F.coalesce(get("max_completion_chars", "int"), F.lit(0)) > 0) & (F.length(strip_special(c)) > get("max_completion_chars", "int")),
        "nonsense_hits": nonsense_hits(c), "code": F.when(asks_code, code), "trailing_text": tail, "patch_failures": patch_failures(c, get("expected_patch", "struct<path:string,removed:string,added:string>")),
        "parsed_json": json_value(c),
    })
    wants_json = get("expected_json").isNotNull()
    whole = canonical_json(strip_special(c))
    given = F.when(F.coalesce(get("strict_json", "boolean"), F.lit(False)), whole).otherwise(F.col("parsed_json"))
    predicted = F.when(F.col("parsed_json").isNotNull(), "json_tool_command").otherwise(rule_label(c, LADDER_RULES))
    out = out.withColumns({
        "syntax_ok": F.when(asks_code, python_syntax_ok("code")), "json_ok": F.when(wants_json, F.coalesce(given == canonical_json(get("expected_json")), F.lit(False))), "patch_ok": F.size("patch_failures") == 0,
        "no_trailing_ok": F.when(F.coalesce(get("no_trailing_text", "boolean"), F.lit(False)), F.col("trailing_text") == ""), "predicted_behavior": predicted,
        "tests_ok": F.when(get("python_assert_tests", "array<string>").isNotNull(), test_runner(run_tests)(F.col("code"), F.array_join(get("python_assert_tests", "array<string>"), "\n"))) if run_tests else F.lit(None).cast("boolean"),
    })
    out = out.withColumn("behavior_correct", F.col("predicted_behavior") == get("expected_behavior"))
    sound = (F.size("nonsense_hits") == 0) | ~F.coalesce(get("no_nonsense", "boolean"), F.lit(True))
    passed = (F.size("missing_required") == 0) & (F.size("present_forbidden") == 0) & ~F.coalesce("too_long", F.lit(False)) & sound
    for rule in ("syntax_ok", "tests_ok", "json_ok", "patch_ok", "no_trailing_ok", "behavior_correct"):
        passed = passed & F.coalesce(F.col(rule), F.lit(True))
    return out.withColumn("passed", passed)


def score_slots(df: DataFrame, completion: str) -> DataFrame:
    """df with the columns of the copy cases: substrings, JSON, key and value order, behaviour, slot_error and ``passed``.

    Keys are enforced where the case expects some, unless enforce_key_sequence
    says otherwise; values only where enforce_value_sequence says so. A slot
    error is a wrong content under the right behaviour.
    """
    c = F.coalesce(F.col(completion), F.lit(""))
    get = lambda n, k="array<string>": _column(df, n, k)
    slots = get("expected_slots", "map<string,string>")
    out = df.withColumns({"missing_required": missing(c, get("required_substrings")), "present_forbidden": F.filter(F.coalesce(get("forbidden_substrings"), F.array().cast("array<string>")), lambda n: F.contains(c, n)), "expected_keys": expected_keys(get("expected_key_sequence"), get("target_keys"), slots)})
    out = out.withColumn("expected_values", expected_values(get("expected_value_sequence"), F.col("expected_keys"), slots))
    keys_on = F.coalesce(get("enforce_key_sequence", "boolean"), F.col("expected_keys").isNotNull())
    values_on = F.coalesce(get("enforce_value_sequence", "boolean"), F.lit(False))
    out = out.withColumns({"generated_keys": F.when(keys_on & F.col("expected_keys").isNotNull(), key_sequence(c, F.col("expected_keys"))), "generated_values": F.when(values_on & F.col("expected_values").isNotNull(), value_sequence(c))})
    same = lambda a, b: F.when(F.col(a).isNotNull(), F.col(a) == F.col(b))
    parsed = json_value(c)
    ruled = F.when(parsed.isNotNull(), "json_tool_command").otherwise(rule_label(c, CURATED_RULES))
    expected = get("expected_behavior", "string")
    copied = lambda name, seq: (expected == name) & (F.size(seq) > 0) & (F.col("ruled") == "unknown")
    out = out.withColumns({"keys_correct": same("generated_keys", "expected_keys"), "values_correct": same("generated_values", "expected_values"), "ruled": ruled, "json_ok": F.when(get("expected_json", "string").isNotNull(), F.coalesce(parsed == canonical_json(get("expected_json", "string")), F.lit(False)))})
    out = out.withColumn("predicted_behavior", F.when(copied("copy_key_sequence", "generated_keys"), "copy_key_sequence").when(copied("copy_value_sequence", "generated_values"), "copy_value_sequence").otherwise(F.col("ruled"))).drop("ruled")
    out = out.withColumn("behavior_correct", F.col("predicted_behavior") == expected)
    wrong = (F.size("missing_required") > 0) | (F.size("present_forbidden") > 0)
    off = (keys_on & ~F.coalesce("keys_correct", F.lit(True))) | (values_on & ~F.coalesce("values_correct", F.lit(True)))
    held = F.when(keys_on, F.coalesce("keys_correct", F.lit(False))).otherwise(True) & F.when(values_on, F.coalesce("values_correct", F.lit(False))).otherwise(True)
    return out.withColumns({"slot_error": F.coalesce("behavior_correct", F.lit(False)) & (wrong | off), "passed": ~wrong & F.coalesce("json_ok", F.lit(True)) & held})


def eval_cases_from_tests(df: DataFrame, key: str, prompt: Column, answer: Column, structured: Column, assertions: Column, function: Column, *, dataset: str, longest: int) -> DataFrame:
    """Executable cases of rows with tests: name, topic, prompt, python_function (JSON) or python_assert_tests, expected_behavior.

    Rows need a prompt, an answer of at most ``longest`` characters that
    defines a function, and structured tests (ARRAY<STRUCT<args, kwargs,
    expected, raises>>) or assert lines; structured ones come first.
    """
    t = df.select(F.col(key).alias("__key"), prompt.alias("__prompt"), answer.alias("__answer"), structured.alias("__tests"), assertions.alias("__asserts"), function.alias("__name"))
    t = t.filter((strip(F.coalesce("__prompt", F.lit(""))) != "") & (F.length("__answer") <= longest) & (F.length("__answer") > 0) & F.col("__name").isNotNull() & ((F.size("__tests") > 0) | (F.size("__asserts") > 0)))
    some = F.size("__tests") > 0
    tests = F.array_join(F.transform("__tests", lambda x: F.concat(F.lit('{"args": '), x["args"], F.lit(', "kwargs": '), x["kwargs"], F.when(x["raises"].isNotNull(), F.concat(F.lit(', "raises": "'), x["raises"], F.lit('"}'))).otherwise(F.concat(F.lit(', "expected": '), F.coalesce(x["expected"], F.lit("null")), F.lit("}"))))), ", ")
    return t.select(
        F.concat(F.lit(f"{dataset}:"), F.col("__key").cast("string")).alias("name"), F.lit(dataset).alias("topic"), F.concat(F.lit("<|user|>\n"), F.col("__prompt"), F.lit("\n<|assistant|>\n")).alias("prompt"), F.lit("function_completion").alias("expected_behavior"),
        F.when(some, F.concat(F.lit('{"name": "'), F.col("__name"), F.lit('", "tests": ['), tests, F.lit("]}"))).alias("python_function"), F.when(~some, F.col("__asserts")).alias("python_assert_tests"),
    )
