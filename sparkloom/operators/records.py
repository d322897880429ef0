"""Normalising, filtering and rendering agent records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import BLANKS, first_text, stable_hash, strip

#: Role names of sources and the canonical ones.
USER_ROLES = ("user", "prompter", "human")
TOOL_ROLES = ("tool", "observation", "environment", "function", "tool_result")
#: Tags of trace steps by type; any other type is an assistant step.
STEP_TAGS = {"tool_call": "tool", "tool_result": "tool_result", "patch": "patch", "test_output": "test_output"}
#: Tags of the parts whose tokens the model is scored on.
OWNED = ("assistant", "tool", "patch", "final")


def normalize_role(role: Column) -> Column:
    """Canonical role; null and blank are user, unheard-of names assistant."""
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return (
        F.when((r == "") | r.isin(*USER_ROLES), "user").when(r == "system", "system").when(r.isin(*TOOL_ROLES), "tool_result").otherwise("assistant")
    )


def normalize_messages(messages: Column) -> Column:
    """Messages with canonical roles, without null entries and blank contents; null gives an empty array."""
    kept = F.filter(messages, lambda m: m.isNotNull() & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    out = F.transform(kept, lambda m: F.struct(normalize_role(m["role"]).alias("role"), m["content"].alias("content")))
    return F.coalesce(out, F.array().cast("array<struct<role:string,content:string>>"))


def is_structured(df: DataFrame) -> Column:
    """A record with text is plain; else it is structured if any structured field is there."""
    parts = [df[c].isNotNull() for c in ("messages", "trace", "final", "repo_context", "system")]
    any_part = parts[0]
    for p in parts[1:]:
        any_part = any_part | p
    return df["text"].isNull() & any_part


def step_tag(kind: Column) -> Column:
    out = F.when(kind == "tool_call", "tool")
    for k in ("tool_result", "patch", "test_output"):
        out = out.when(kind == k, k)
    return out.otherwise("assistant")


def segments() -> Column:
    """ARRAY<STRUCT<tag, body>> of a record in rendering order; blank parts are left out."""
    one = lambda tag, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.array(F.struct(F.lit(tag).alias("tag"), c.alias("body")))).otherwise(_none())
    messages = F.transform(normalize_messages(F.col("messages")), lambda m: F.struct(m["role"].alias("tag"), m["content"].alias("body")))
    steps = F.filter(F.coalesce(F.col("trace"), F.array().cast("array<struct<type:string,content:string>>")), lambda t: F.trim(F.coalesce(t["content"], F.lit(""))) != "")
    steps = F.transform(steps, lambda t: F.struct(step_tag(t["type"]).alias("tag"), t["content"].alias("body")))
    return F.concat(one("system", F.col("system")), one("repo_context", F.col("repo_context")), messages, steps, one("final", F.col("final")))


def loss_pieces() -> Column:
    """ARRAY<STRUCT<body, own>> of a record as it is rendered for training: roles as they stand, blank contents kept; a plain record is one owned piece.

    Owned are assistant messages, tool calls, patches, other steps and the
    final answer; not owned are system, context, other messages, tool results
    and test output. A null content counts as empty.
    """
    body = lambda tag, c: F.concat(F.lit("<|"), tag, F.lit("|>\n"), F.coalesce(c, F.lit("")), F.lit("\n"))
    piece = lambda b, own: F.struct(b.alias("body"), own.alias("own"))
    none = F.array().cast("array<struct<body:string,own:boolean>>")
    one = lambda tag, c, own: F.when(F.coalesce(c, F.lit("")) != "", F.array(piece(body(F.lit(tag), c), F.lit(own)))).otherwise(none)
    role = lambda m: F.coalesce(m["role"], F.lit("user"))
    messages = F.transform(F.filter(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), lambda m: m.isNotNull()), lambda m: piece(body(role(m), m["content"]), role(m) == "assistant"))
    steps = F.transform(F.filter(F.coalesce("trace", F.array().cast("array<struct<type:string,content:string>>")), lambda t: t.isNotNull()), lambda t: piece(body(step_tag(t["type"]), t["content"]), ~F.coalesce(t["type"].isin("tool_result", "test_output"), F.lit(False))))
    whole = F.concat(one("system", F.col("system"), False), one("repo_context", F.col("repo_context"), False), messages, steps, one("final", F.col("final"), True))
    return F.when(F.col("text").isNotNull(), F.array(piece(F.regexp_replace("text", f"^{BLANKS}+", ""), F.lit(True)))).otherwise(whole)


def _none() -> Column:
    return F.array().cast("array<struct<tag:string,body:string>>")


def render() -> Column:
    """Tagged text of a record; a plain record is its text. Parts are joined by newlines and one newline ends the text."""
    body = F.transform(segments(), lambda s: F.concat(F.lit("<|"), s["tag"], F.lit("|>\n"), s["body"]))
    return F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.concat(F.array_join(body, "\n"), F.lit("\n")))


def render_prompt(system: str = "") -> Column:
    """The rendering up to where the assistant is to answer: system (or a default), context where there is some, messages; no steps."""
    part = lambda tag, c: F.concat(F.lit("\n<|"), tag, F.lit("|>\n"), F.coalesce(c, F.lit("")), F.lit("\n"))
    messages = F.transform(F.filter(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), lambda m: m.isNotNull()), lambda m: part(F.coalesce(m["role"], F.lit("user")), m["content"]))
    context = F.when(F.coalesce("repo_context", F.lit("")) != "", part(F.lit("repo_context"), F.col("repo_context"))).otherwise("")
    return F.concat(F.lit("<|system|>\n"), F.coalesce("system", F.lit(system)), F.lit("\n"), context, F.array_join(messages, ""), F.lit("\n<|assistant|>\n"))


def user_prompt(prompt: Column) -> Column:
    """The first user's part of a rendered prompt; a prompt without the user's tag as a whole."""
    rest = F.substring_index(F.substr(prompt, F.instr(prompt, F.lit("<|user|>\n")) + 9), "\n\n<|assistant|>", 1)
    return F.when(F.contains(prompt, F.lit("<|user|>\n")), strip(rest)).otherwise(prompt)


def render_plain() -> Column:
    """Parts without tags, for length limits only."""
    return F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.array_join(F.transform(segments(), lambda s: s["body"]), "\n"))


def first_failing(reasons: list[tuple[str, Column]], passed: str = "kept") -> Column:
    """Label of the first condition that holds, else passed; null conditions don't hold."""
    out = None
    for label, bad in reasons:
        out = F.when(bad, label) if out is None else out.when(bad, label)
    return out.otherwise(passed) if out is not None else F.lit(passed)


def status_or_fallback(*flags: Column) -> Column:
    """First flag that is true, else the last one: a false flag falls through to the next."""
    return F.coalesce(*[F.when(f, True) for f in flags[:-1]], flags[-1])


def score_passes(least: float, *scores: Column) -> Column:
    """First score that is a number against a minimum; without any the row passes. NaN is no number."""
    first = F.coalesce(*[F.nanvl(s.try_cast("double"), F.lit(None)) for s in scores])
    return first.isNull() | (first >= least)


def reply_pairs(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Each assistant turn with the latest user turn before it in its record: key, user_pos, user_text, assistant_pos, assistant_text.

    ``turns`` has key, order, role and text. Assistant turns without a user
    turn before them are dropped.
    """
    w = Window.partitionBy(key).orderBy(order)
    user = F.last(F.when(F.col("role") == "user", F.struct(F.col(order).alias("p"), F.col("text").alias("t"))), ignorenulls=True).over(w)
    out = turns.withColumn("__u", user).filter((F.col("role") == "assistant") & F.col("__u").isNotNull())
    return out.select(key, F.col("__u.p").alias("user_pos"), F.col("__u.t").alias("user_text"), F.col(order).alias("assistant_pos"), F.col("text").alias("assistant_text"))


def threaded_pairs(rows: DataFrame, keep: Column) -> DataFrame:
    """(parent_id, message_id, prompt, answer) of a thread table: message_id, parent_id, role, text, ord.

    The parent must be a user row that passes keep and comes before the child;
    of several rows with the parent's id the latest such one counts.
    """
    parents = rows.filter(keep & (normalize_role(F.col("role")) == "user")).select(F.col("message_id").alias("parent_id"), F.col("ord").alias("p_ord"), F.col("text").alias("prompt"))
    children = rows.filter(keep & (normalize_role(F.col("role")) == "assistant") & F.col("parent_id").isNotNull())
    joined = children.join(parents, "parent_id").filter("p_ord < ord")
    w = Window.partitionBy("message_id", "ord").orderBy(F.col("p_ord").desc())
    return joined.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("parent_id", "message_id", "prompt", F.col("text").alias("answer"))


def canonical(df: DataFrame) -> DataFrame:
    """Canonical provenance columns: source_id with a fallback from the record id, curriculum source, license where there is one."""
    source_id = F.substring(first_text(F.col("source_id"), F.format_string("row_%06d", F.col("record_id"))), 1, 120)
    return df.select(
        "record_id", F.coalesce(strip(F.col("topic")), F.lit("")).alias("topic"), F.coalesce(strip(F.col("behavior")), F.lit("")).alias("behavior"), source_id.alias("source_id"),
        F.concat(F.coalesce("source_dataset", F.lit("")), F.lit(":"), source_id).alias("curriculum_source"), F.nullif(F.lower(strip(F.col("license"))), F.lit("")).alias("license"),
    )


def code_test_snippet(tests: Column, limit: int) -> Column:
    """Of ARRAY<STRUCT<code, far, frr>> the snippet of least far + frr, then shortest, then first by text, that fits limit; '' without one."""
    ranked = F.array_sort(F.transform(tests, lambda t: F.struct((F.coalesce(t["far"], F.lit(0.0)) + F.coalesce(t["frr"], F.lit(0.0))).alias("p"), F.length(t["code"]).alias("n"), t["code"].alias("code"))))
    fitting = F.filter(ranked, lambda t: t["n"] <= limit)
    return F.coalesce(F.try_element_at(fitting, F.lit(1))["code"], F.lit(""))


def document_hash() -> Column:
    return stable_hash(F.col("text"))
