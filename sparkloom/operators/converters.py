"""Raw source rows to canonical records: each converter filters, reshapes and says why it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.python_udfs import first_function_name, python_syntax_ok, unified_diff
from sparkloom.functions.text import extract_fenced, fenced, first_text, line_count, order_hash, strip
from sparkloom.operators.curriculum import contains_any
from sparkloom.operators.records import first_failing, normalize_messages, score_passes, status_or_fallback

_STEPS = "array<struct<type:string,content:string>>"
_TURNS = "array<struct<role:string,content:string>>"
#: Tests longer than this are not shown in a prompt.
SHOWN_TESTS = 1600


def column(df: DataFrame, *names: str) -> Column:
    """First non-blank of the named columns that df has; null without any."""
    there = [F.col(n).cast("string") for n in names if n in df.columns]
    return first_text(*there) if there else F.lit(None).cast("string")


def python_row(df: DataFrame) -> Column:
    """Language says python, or py, or nothing; else a fence or a function line in the code decides."""
    said = F.lower(F.coalesce(column(df, "language", "lang"), F.lit("")))
    code = F.coalesce(column(df, "solution", "answer", "code", "func_code", "content"), F.lit(""))
    return (said == "") | F.contains(said, F.lit("python")) | (said == "py") | F.contains(code, F.lit("```python")) | code.rlike(r"(?m)^\s*def \w+\(")


def trajectories(df: DataFrame, *, source: str, languages: list[str], resolved_only: bool) -> DataFrame:
    """Agent trajectories: the leading system turn hoisted, provenance lines as context, patches as trace steps."""
    lang = F.lower(F.trim(F.coalesce(column(df, "language"), F.lit(""))))
    keep = F.lit(True)
    if languages:
        keep = keep & ((lang == "") | lang.isin(*languages))
    if resolved_only:
        keep = keep & F.coalesce(F.lower(F.col("resolved").cast("string")).isin("1", "true"), F.lit(False))
    m = normalize_messages(F.col("trajectory"))
    t = df.filter(keep).withColumn("__m", m).filter(F.size("__m") > 0)
    leads = F.element_at("__m", 1)["role"] == "system"
    lines = [F.when(F.coalesce(column(df, c), F.lit("")) != "", F.concat(F.lit(f"{c}: "), column(df, c))) for c in ("instance_id", "repo", "license", "language", "dataset")]
    reference = F.try_variant_get(F.try_parse_json("metadata"), "$.reference_patch.patch", "string") if "metadata" in df.columns else F.lit(None).cast("string")
    patches = F.filter(F.array(strip(column(df, "model_patch")), reference), lambda p: F.coalesce(p, F.lit("")) != "")
    return t.select(
        F.when(leads, F.element_at("__m", 1)["content"]).otherwise("").alias("system"), F.concat_ws("\n", F.lit(f"source: {source}"), *lines).alias("repo_context"),
        F.when(leads, F.slice("__m", 2, F.size("__m"))).otherwise(F.col("__m")).alias("messages"), F.transform(patches, lambda p: F.struct(F.lit("patch").alias("type"), p.alias("content"))).cast(_STEPS).alias("trace"), F.lit("").alias("final"),
    )


def conversations(df: DataFrame, *, english_only: bool) -> DataFrame:
    """Conversations that are not flagged exactly true; an unknown language passes; empty ones are dropped."""
    t = df.filter(~F.col("toxic").eqNullSafe(True))
    if english_only:
        t = t.filter(F.coalesce(F.lower(F.trim("language")), F.lit("")).isin("", "en", "english"))
    return t.select(normalize_messages(F.col("conversation")).alias("messages")).filter(F.size("messages") > 0)


def texts(df: DataFrame, *, source: str) -> DataFrame:
    """Plain text rows under a header line; blank ones are dropped."""
    return df.select(column(df, "content", "text").alias("t")).filter("t IS NOT NULL").select(F.concat(F.lit(f"# source: {source}\n"), F.col("t")).alias("text"))


def record(user: Column, assistant: Column, *, topic: str, behavior: Column, dataset: str, source_id: Column, context: Column | None = None, license_: Column | None = None) -> list[Column]:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    null = F.lit(None).cast("string")
    return [
        F.lit(topic).alias("topic"), behavior.alias("behavior"), F.array(turn("user", user), turn("assistant", assistant)).cast(_TURNS).alias("messages"), F.lit(dataset).alias("source_dataset"), source_id.alias("source_id"),
        F.concat(F.lit(f"{dataset}:"), source_id).alias("_curriculum_source"), (F.nullif(strip(context), F.lit("")) if context is not None else null).alias("repo_context"), (F.nullif(strip(license_), F.lit("")) if license_ is not None else null).alias("license"),
    ]


def source_id(df: DataFrame, ordinal: Column) -> Column:
    return F.substring(F.coalesce(column(df, "id", "task_id", "instance_id", "uuid"), F.format_string("row_%06d", ordinal)), 1, 120)


def test_text(df: DataFrame) -> Column:
    """First test payload that is there, as text."""
    return column(df, "unit_tests", "tests", "test_cases", "test", "test_list")


def code_questions(df: DataFrame, ordinal: Column, *, dataset: str, least_score: float, need_tests: bool, longest: int) -> tuple[DataFrame, DataFrame]:
    """(records, reasons) of question and solution rows; reasons counts every row by the first condition it fails."""
    names = ("average_test_score", "test_score", "score", "pass_rate")
    scores = [F.col(c) for c in names if c in df.columns]
    flags = [F.col(c).try_cast("boolean") for c in ("passed", "is_correct") if c in df.columns] or [F.lit(None).cast("boolean")]
    prompt, answer, tests = column(df, "question", "instruction", "problem", "prompt", "input"), column(df, "answer", "solution", "response", "output", "completion", "code"), test_text(df)
    reason = first_failing([
        ("language", ~python_row(df)), ("score", ~score_passes(least_score, *scores) if scores else F.lit(False)), ("status", ~F.coalesce(status_or_fallback(*flags), F.lit(True))),
        ("prompt", prompt.isNull()), ("answer", answer.isNull()), ("tests", (tests.isNull() & (F.coalesce(*[s.try_cast("double") for s in scores]).isNull() if scores else F.lit(True))) if need_tests else F.lit(False)), ("length", F.length(answer) > longest),
    ])
    t = df.withColumns({"__reason": reason, "__p": prompt, "__a": answer, "__t": tests, "__id": source_id(df, ordinal)})
    kept = t.filter("__reason = 'kept'").withColumn("__code", F.coalesce(extract_fenced(F.col("__a")), F.col("__a")))
    kept = kept.withColumn("__f", first_function_name("__code"))
    user = F.when(F.length("__t") < SHOWN_TESTS, F.concat("__p", F.lit("\n\nUse these tests as the behavioral contract:\n"), "__t")).otherwise(F.col("__p"))
    whole = F.col("__f").isNotNull()
    assistant = F.when(whole & ~F.contains("__a", F.lit("```")), fenced(F.col("__code"), "python")).otherwise(F.col("__a"))
    out = kept.select(*record(user, assistant, topic="code_question", behavior=F.when(whole, "function_completion").otherwise("code_generation"), dataset=dataset, source_id=F.col("__id"), license_=column(df, "license")))
    return out, t.groupBy(F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def functions(df: DataFrame, ordinal: Column, *, dataset: str, most_lines: int) -> DataFrame:
    """Function rows that parse and are short enough, with a prompt from their signature and docstring."""
    raw = column(df, "func_code", "function", "function_body", "code", "content")
    t = df.withColumns({"__code": F.coalesce(extract_fenced(raw), raw), "__id": source_id(df, ordinal)}).filter(python_row(df) & F.col("__code").isNotNull())
    t = t.filter(line_count(F.col("__code")) <= most_lines).withColumns({"__ok": python_syntax_ok("__code"), "__f": first_function_name("__code")}).filter("__ok AND __f IS NOT NULL")
    doc = column(df, "docstring", "documentation", "description", "summary")
    prompt = F.concat_ws("\n", F.concat(F.lit("Implement the Python function `"), F.coalesce(column(df, "signature", "function_signature"), F.concat("__f", F.lit("(...)"))), F.lit("`.")), F.when(doc.isNotNull(), F.concat(F.lit("Docstring/behavior:\n"), doc)), F.lit("Return only a Python code block."))
    context = F.concat_ws("\n", *[F.when(column(df, c).isNotNull(), F.concat(F.lit(f"{c}: "), column(df, c))) for c in ("path", "repo")])
    return t.select(*record(prompt, fenced(F.col("__code"), "python"), topic="function", behavior=F.lit("function_completion"), dataset=dataset, source_id=F.col("__id"), context=context, license_=column(df, "license")))


def code_with_tests(df: DataFrame, ordinal: Column, tests: Column, *, dataset: str, longest_code: int) -> DataFrame:
    """None, one or two records a row: write the tests, and with a prompt also write the code."""
    raw = column(df, "code_ground_truth", "ground_truth", "canonical_solution", "solution", "code", "answer")
    t = df.withColumns({"__code": F.coalesce(extract_fenced(raw), raw), "__tests": tests, "__id": source_id(df, ordinal), "__p": column(df, "question", "prompt", "instruction", "problem")})
    t = t.filter(python_row(df) & (F.coalesce("__tests", F.lit("")) != "") & (F.length("__code") <= longest_code)).filter(python_syntax_ok("__code"))
    code, own = fenced(F.col("__code"), "python"), F.when(F.contains("__tests", F.lit("```")), F.col("__tests")).otherwise(fenced(F.col("__tests"), "python"))
    a = F.struct(*record(F.concat(F.lit("Write focused pytest tests for this Python code:\n"), code), own, topic="code_pytest", behavior=F.lit("pytest_generation"), dataset=dataset, source_id=F.col("__id")))
    b = F.struct(*record(F.concat("__p", F.lit("\n\nThe implementation should satisfy these tests:\n"), "__tests"), code, topic="code_implementation", behavior=F.lit("function_completion"), dataset=dataset, source_id=F.concat("__id", F.lit(":implementation"))))
    return t.select(F.explode(F.array_compact(F.array(a, F.when(F.col("__p").isNotNull(), b)))).alias("r")).select("r.*")


def commits(df: DataFrame, ordinal: Column, *, dataset: str, most_lines: int, longest: int) -> DataFrame:
    """Commits as patch records: changed files of bounded size whose unified diff is short; a path without suffix gets .py."""
    t = df.filter(F.col("old_contents").isNotNull() & F.col("new_contents").isNotNull() & (F.col("old_contents") != F.col("new_contents")) & (F.length("old_contents") <= longest) & (F.length("new_contents") <= longest))
    path = F.coalesce(column(df, "path", "new_file", "old_file"), F.lit("file"))
    t = t.withColumns({"__path": F.when(path.endswith(".py"), path).otherwise(F.concat(path, F.lit(".py"))), "__id": source_id(df, ordinal)})
    t = t.withColumn("__d", unified_diff("__path", "old_contents", "new_contents")).filter((F.size("__d") > 0) & (F.size("__d") <= most_lines))
    context = F.concat(F.lit("file: "), F.col("__path"), F.lit("\n"), F.rtrim("old_contents"))
    user = F.coalesce(column(df, "commit_message", "message", "subject"), F.lit("Apply the change."))
    return t.select(*record(user, F.concat(F.lit("```diff\n"), F.array_join("__d", "\n"), F.lit("\n```")), topic="commit", behavior=F.lit("patch"), dataset=dataset, source_id=F.col("__id"), context=context, license_=column(df, "license")))


def structured_tests(payload: Column) -> Column:
    """ARRAY<STRUCT<args, kwargs, expected, raises>> (JSON texts) of the three test shapes; anything else gives none.

    A list; an object with tests, unit_tests or cases; items with args,
    expected or raises, or with input and output, where a scalar input becomes
    a list of one.
    """
    v = F.try_parse_json(payload)
    pick = lambda p: F.try_variant_get(v, p, "array<variant>")
    items = F.coalesce(pick("$"), pick("$.tests"), pick("$.unit_tests"), pick("$.cases"), F.array().cast("array<variant>"))
    get = lambda i, p: F.try_variant_get(i, p, "string")
    as_list = lambda x: F.when(F.startswith(F.trim(x), F.lit("[")), x).otherwise(F.concat(F.lit("["), x, F.lit("]")))

    def one(i: Column) -> Column:
        raw_in = F.to_json(F.try_variant_get(i, "$.input", "variant"))
        direct = get(i, "$.args").isNotNull() | get(i, "$.expected").isNotNull() | get(i, "$.raises").isNotNull()
        return F.when(
            direct,
            F.struct(F.coalesce(F.to_json(F.try_variant_get(i, "$.args", "variant")), F.lit("[]")).alias("args"), F.coalesce(F.to_json(F.try_variant_get(i, "$.kwargs", "variant")), F.lit("{}")).alias("kwargs"), F.when(get(i, "$.raises").isNull(), F.to_json(F.try_variant_get(i, "$.expected", "variant"))).alias("expected"), get(i, "$.raises").alias("raises")),
        ).when(
            raw_in.isNotNull() & get(i, "$.output").isNotNull(),
            F.struct(as_list(raw_in).alias("args"), F.lit("{}").alias("kwargs"), F.to_json(F.try_variant_get(i, "$.output", "variant")).alias("expected"), F.lit(None).cast("string").alias("raises")),
        )

    return F.array_compact(F.transform(items, one))


def assertion_lines(snippets: Column, *, most: int = 8, chars: int = 4000) -> Column:
    """The assert lines of ARRAY<STRING> snippets, stripped, as a prefix that keeps both limits: it ends at the first line too much."""
    lines = F.flatten(F.transform(F.filter(snippets, lambda s: s.isNotNull()), lambda s: F.split(s, r"\R")))
    asserts = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x.startswith("assert "))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def add(a: Column, x: Column) -> Column:
        stop = a["done"] | (a["n"] + F.length(x) > chars) | (F.size(a["kept"]) >= most)
        return F.when(stop, F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct(F.array_append(a["kept"], x).alias("kept"), (a["n"] + F.length(x)).alias("n"), F.lit(False).alias("done")))

    return F.aggregate(asserts, start, add, lambda a: a["kept"])


def route(df: DataFrame, key: str, *, fraction: float, seed: int) -> DataFrame:
    """df with dest: eval for rows flagged or split off for it, and for a hashed share of the rest; else train."""
    flagged = F.lit(False)
    if "eval_only" in df.columns:
        flagged = flagged | F.coalesce(F.col("eval_only").try_cast("boolean"), F.lit(False))
    if "split" in df.columns:
        flagged = flagged | F.coalesce(F.lower(F.trim("split")).isin("eval", "test", "validation", "heldout", "held_out"), F.lit(False))
    share = F.conv(F.substring(order_hash(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("dest", F.when(flagged | (share < fraction), "eval").otherwise("train"))


def validate(df: DataFrame, *, behaviors: list[str], required: list[str], anchors: list[str], forbidden: list[str]) -> DataFrame:
    """(problem, subject, n): rows by the first rule they break, and required and anchor topics no valid row has. No row means valid."""
    bad = first_failing([
        ("empty_final", F.trim(F.coalesce("final", F.lit(""))) == ""), ("behavior", ~F.coalesce(F.col("behavior").isin(*behaviors), F.lit(False))), ("topic", ~F.coalesce(F.col("topic").isin(*required, *anchors), F.lit(False))),
        ("forbidden", contains_any(forbidden, F.coalesce("final", F.lit("")))),
    ], "valid")
    t = df.withColumn("problem", bad)
    rows = t.filter("problem <> 'valid'").groupBy("problem", F.coalesce("topic", F.lit("")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    asked = df.sparkSession.createDataFrame([("missing_topic", x) for x in required] + [("missing_anchor", x) for x in anchors], "problem string, subject string")
    there = t.filter("problem = 'valid'").select(F.col("topic").alias("subject")).distinct()
    return rows.unionByName(asked.join(there, "subject", "left_anti").withColumn("n", F.lit(0).cast("bigint")))


def examples(df: DataFrame, group: str, key: str, n: int = 3) -> DataFrame:
    """First n rows of each group with the sorted names of their filled columns."""
    w = Window.partitionBy(group).orderBy(key)
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in df.columns])))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).select(group, key, names.alias("columns"))
