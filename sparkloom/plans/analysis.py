"""Queries q34 to q57: scoring, step logs, registry and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import costs, schedules
from sparkloom.functions.text import count_of, key_values, line_count, missing, preview
from sparkloom.operators import runlog, scoring
from sparkloom.plans.corpus import big
from sparkloom.plans.registry import query
from sparkloom.plans.rules import LOG, RESULTS
from sparkloom.tables import load

PI = "3.141592653589793"


def _log(s: SparkSession, d: str) -> DataFrame:
    return runlog.clean_log(load(s, d, "train_log"))


def _results(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "eval_results").distinct()


def r6(c, digits: int = 6) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_NEEDS = "coalesce(list_filter(required_substrings, lambda x: NOT contains(coalesce(text, ''), x)), [])"


@query("q34", f"""
SELECT item_id, array_to_string({_NEEDS}, ',') AS missing, (coalesce(len(required_substrings), 0) - len({_NEEDS}))::BIGINT AS n_present, len({_NEEDS}) = 0 AND coalesce(length(text) <= max_completion_chars, TRUE) AS passed FROM benchmark""")  # fmt: skip
def q34(s, d):
    """Missing and present substrings of each item in its own text, and whether it passes with its length cap."""
    t = scoring.substring_score(load(s, d, "benchmark"), "text", "required_substrings", "max_completion_chars")
    return t.select("item_id", F.array_join("missing", ",").alias("missing"), "n_present", "passed")


_INFER = """CASE WHEN starts_with(low, '{') AND contains(low, '"cmd"') THEN 'json_tool_command' WHEN contains(low, '--- a/') OR contains(low, '```diff') THEN 'patch' WHEN contains(low, 'def ') AND contains(low, 'return') THEN 'complete_function'
 WHEN contains(low, 'guard') OR contains(low, 'test') THEN 'review' WHEN contains(low, 'because') OR contains(low, 'cause') THEN 'explain' ELSE 'unknown' END"""
_JUDGED = f"""SELECT record_id, behavior AS expected, {_INFER} AS predicted FROM
 (SELECT record_id, any_value(behavior) AS behavior, any_value(lower(coalesce(array_to_string(list_transform(trace, lambda t: t.content), chr(10)), ''))) AS low FROM agentcoder_slice_train GROUP BY 1)"""


def _judged(s, d) -> DataFrame:
    t = load(s, d, "agentcoder_slice_train").select("record_id", F.col("behavior").alias("expected"), scoring.infer_behavior(F.array_join("trace.content", "\n")).alias("predicted"))
    return t.groupBy("record_id").agg(F.max("expected").alias("expected"), F.max("predicted").alias("predicted"))


@query("q35", f"SELECT {_INFER} AS behavior, count(*)::BIGINT AS n FROM (SELECT lower(coalesce(text, '')) AS low FROM documents) GROUP BY 1")
def q35(s, d):
    """Documents by the first rule of the cascade that holds."""
    return load(s, d, "documents").groupBy(scoring.infer_behavior(F.col("text")).alias("behavior")).agg(F.count(F.lit(1)).alias("n"))


@query("q36", f"SELECT expected, predicted, count(*)::BIGINT AS n FROM ({_JUDGED}) WHERE expected IS NOT NULL GROUP BY 1, 2")
def q36(s, d):
    """Confusion counts of stated and inferred behaviour."""
    return scoring.confusion(_judged(s, d), "expected", "predicted")


@query("q37", f"""
SELECT count(*)::BIGINT AS labelled, count(*) FILTER (WHERE expected = predicted)::BIGINT AS correct, round(count(*) FILTER (WHERE expected = predicted) / count(*)::DOUBLE, 6) AS accuracy FROM ({_JUDGED}) WHERE expected IS NOT NULL""")  # fmt: skip
def q37(s, d):
    """Accuracy over the labelled records."""
    return scoring.accuracy(scoring.confusion(_judged(s, d), "expected", "predicted")).withColumn("accuracy", r6("accuracy"))


@query("q38", f"""
SELECT coalesce(slot_family, '*') AS slot_family, coalesce(eval_tier, '*') AS eval_tier, count(*)::BIGINT AS rows, count(passed)::BIGINT AS cases, count(*) FILTER (WHERE passed)::BIGINT AS passes,
 round(count(*) FILTER (WHERE passed) / nullif(count(passed), 0)::DOUBLE, 6) AS pass_rate, grouping_id(slot_family, eval_tier)::BIGINT AS level FROM ({RESULTS}) JOIN benchmark USING (item_id) GROUP BY ROLLUP (slot_family, eval_tier)""")  # fmt: skip
def q38(s, d):
    """Pass rates by family and tier with their roll-ups."""
    t = _results(s, d).join(load(s, d, "benchmark").select("item_id", "slot_family", "eval_tier"), "item_id")
    out = scoring.pass_rates(t, ["slot_family", "eval_tier"])
    return out.withColumns({"slot_family": F.coalesce("slot_family", F.lit("*")), "eval_tier": F.coalesce("eval_tier", F.lit("*")), "pass_rate": r6("pass_rate")})


_KV = "list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(x, '=')), lambda x: {'k': trim(string_split(x, '=')[1]), 'v': trim(regexp_replace(x, '^[^=]*=', ''))})"


@query("q39", f"""
SELECT doc_id, len({_KV})::BIGINT AS n_pairs, len(list_distinct(list_transform({_KV}, lambda p: p.k)))::BIGINT AS n_keys, coalesce(list_sum(list_transform({_KV}, lambda p: length(p.v))), 0)::BIGINT AS value_chars,
 len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_lines FROM documents""")  # fmt: skip
def q39(s, d):
    """k=v lines of each document."""
    kv = key_values(F.col("text"))
    chars = F.aggregate(kv, F.lit(0).cast("bigint"), lambda a, p: a + F.length(p["value"]))
    keys = F.array_distinct(F.transform(kv, lambda p: p["key"]))
    return load(s, d, "documents").select("doc_id", big(F.size(kv)).alias("n_pairs"), big(F.size(keys)).alias("n_keys"), chars.alias("value_chars"), line_count(F.col("text")).alias("n_lines"))


@query("q40", "SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE json_valid(props))::BIGINT AS valid FROM events GROUP BY 1")
def q40(s, d):
    """Rows whose properties are valid JSON."""
    ok = F.try_parse_json("props").isNotNull()
    return load(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


@query("q41", """
SELECT doc_id, length(trim(coalesce(text, '')))::BIGINT AS n_chars, ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '<|', ''))) // 2)::BIGINT AS n_markers,
 contains(coalesce(text, ''), '```') AS has_fence, contains(coalesce(text, ''), '--- a/') AS has_diff, contains(lower(coalesce(text, '')), 'pytest') AS has_test FROM documents""")  # fmt: skip
def q41(s, d):
    """Lexical flags of each document."""
    t = F.coalesce("text", F.lit(""))
    has = lambda c, x: F.contains(c, F.lit(x))
    return load(s, d, "documents").select(
        "doc_id", big(F.length(F.trim(t))).alias("n_chars"), count_of(t, "<|").alias("n_markers"), has(t, "```").alias("has_fence"), has(t, "--- a/").alias("has_diff"), has(F.lower(t), "pytest").alias("has_test")
    )


_ONE = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("q42", f"SELECT doc_id, CASE WHEN length({_ONE}) > 80 THEN substr({_ONE}, 1, 77) || '...' ELSE {_ONE} END AS preview FROM documents")
def q42(s, d):
    """Preview of each document."""
    return load(s, d, "documents").select("doc_id", preview(F.col("text"), 80).alias("preview"))


_AT = "CASE WHEN {c} IS NOT NULL THEN {{'s': global_step, 'v': {c}}} END"
_TL, _VL = _AT.format(c="train_loss"), _AT.format(c="val_next_token_loss")


@query("q43", f"""
SELECT run_id, count(*)::BIGINT AS n_steps, min(global_step) AS first_step, max(global_step) AS last_step, round(min({_TL}).v, 6) AS first_loss, round(max({_TL}).v, 6) AS last_loss,
 round(min({_VL}).v, 6) AS first_val, round(max({_VL}).v, 6) AS last_val, round(max({_VL}).v - min({_VL}).v, 6) AS val_delta FROM ({LOG}) GROUP BY 1""")  # fmt: skip
def q43(s, d):
    """First and last state of each run."""
    t = runlog.summarize_runs(_log(s, d), "train_loss", "val_next_token_loss")
    return t.select("run_id", "n_steps", "first_step", "last_step", *[r6(c).alias(c) for c in ("first_loss", "last_loss", "first_val", "last_val", "val_delta")])


@query("q44", f"SELECT run_id, round(b.v, 6) AS best_val, b.s AS best_step FROM (SELECT run_id, min({{'v': val_next_token_loss, 's': global_step}}) AS b FROM ({LOG}) WHERE val_next_token_loss IS NOT NULL GROUP BY 1)")
def q44(s, d):
    """Earliest minimum of the validation loss per run."""
    t = runlog.summarize_runs(_log(s, d), "train_loss", "val_next_token_loss")
    return t.filter("best_step IS NOT NULL").select("run_id", r6("best_val").alias("best_val"), "best_step")


@query("q45", f"""
WITH v AS (SELECT run_id, global_step, val_next_token_loss AS value FROM ({LOG}) WHERE val_next_token_loss IS NOT NULL),
 b AS (SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY global_step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
 i AS (SELECT *, before IS NULL OR value < before AS improved, sum(CASE WHEN before IS NULL OR value < before THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY global_step) AS island FROM b)
SELECT run_id, global_step, round(least(value, coalesce(before, value)), 6) AS best, improved, (row_number() OVER (PARTITION BY run_id, island ORDER BY global_step) - 1)::BIGINT AS streak FROM i""")  # fmt: skip
def q45(s, d):
    """Running best and rows since the last improvement."""
    t = runlog.progress(_log(s, d), "val_next_token_loss")
    return t.select("run_id", "global_step", r6("best").alias("best"), "improved", "streak")


@query("q46", f"""
SELECT i::BIGINT AS step, round(CASE WHEN i < 100 THEN 0.0003 * (i + 1) / 100 WHEN i >= 400 THEN 0.00003 + 0.00027 * 0.5 * (1 + cos({PI} * least(1.0, greatest(0.0, (i - 400) / 599.0::DOUBLE)))) ELSE 0.0003 END::DOUBLE, 9) AS lr FROM range(1200) t(i)""")  # fmt: skip
def q46(s, d):
    """Learning rate of each step."""
    lr = schedules.lr_for_step(F.col("id"), 0.0003, 100, cosine=True, least=0.00003, start=400, end=1000)
    return s.range(1200).select(F.col("id").alias("step"), r6(lr, 9).alias("lr"))


@query("q47", """
SELECT i::BIGINT AS step, h::BIGINT AS horizon, round(CASE WHEN i < h * 100 THEN 0.0 ELSE (0.4 / h) * least(1.0, (i - h * 100 + 1) / 50.0) END::DOUBLE, 9) AS weight FROM range(600) t(i), range(2, 5) u(h)""")  # fmt: skip
def q47(s, d):
    """Weight of each horizon at each step."""
    t = s.range(600).select(F.col("id").alias("step"), F.explode(F.array(*[F.lit(h) for h in (2, 3, 4)])).alias("horizon"))
    cases = F.lit(0.0)
    for h in (2, 3, 4):
        cases = F.when(F.col("horizon") == h, schedules.ramp(F.col("step"), h * 100, 50, 0.4 / h)).otherwise(cases)
    return t.select("step", big("horizon").alias("horizon"), r6(cases, 9).alias("weight"))


@query("q48", f"""
SELECT run_id, global_step, round(last_value(val_next_token_loss IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY global_step), 6) AS last_val FROM ({LOG})""")  # fmt: skip
def q48(s, d):
    """Last validation loss known at each step."""
    t = runlog.carry_forward(_log(s, d), "val_next_token_loss", "last_val")
    return t.select("run_id", "global_step", r6("last_val").alias("last_val"))


@query("q49", f"""
SELECT run_id, round(avg(step_time_ms), 4) AS mean_ms, round(list_sort(list(step_time_ms))[(round_even(0.95::DOUBLE * (count(step_time_ms) - 1), 0) + 1)::BIGINT], 4) AS p95_ms FROM ({LOG}) WHERE step_time_ms IS NOT NULL GROUP BY 1""")  # fmt: skip
def q49(s, d):
    """Mean and nearest-rank 95th percentile of step times."""
    t = _log(s, d).filter("step_time_ms IS NOT NULL")
    p95 = runlog.nearest_ranks(t, "run_id", "step_time_ms", 0.95, "p95_ms")
    means = t.groupBy("run_id").agg(r6(F.avg("step_time_ms"), 4).alias("mean_ms"))
    return means.join(p95, "run_id").select("run_id", "mean_ms", r6("p95_ms", 4).alias("p95_ms"))


@query("q50", f"""
SELECT run_id, count(*)::BIGINT AS n, round(avg(generated_tokens), 6) AS mean, round(coalesce(stddev_pop(generated_tokens), 0.0), 6) AS std, bool_and(passed) AS all_true, bool_or(passed) AS any_true FROM ({RESULTS}) GROUP BY 1""")  # fmt: skip
def q50(s, d):
    """Group statistics of a sweep."""
    return runlog.group_stats(_results(s, d), "run_id", "generated_tokens", "passed").withColumns({"mean": r6("mean"), "std": r6("std")})


@query("q51", f"""
SELECT checkpoint, coalesce(b.at, -1)::BIGINT AS first_item, round(coalesce(b.value, -1), 6) AS first_rate FROM (SELECT checkpoint, min(CASE WHEN rate < 0.3 THEN {{'at': item_id, 'value': rate}} END) AS b FROM
 (SELECT lower(trim(checkpoint)) AS checkpoint, item_id, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate FROM ({RESULTS}) GROUP BY 1, 2) GROUP BY 1)""")  # fmt: skip
def q51(s, d):
    """First item of each checkpoint whose pass rate is below the threshold; -1 where none is."""
    rates = _results(s, d).groupBy(F.lower(F.trim("checkpoint")).alias("checkpoint"), "item_id").agg(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("rate"))
    t = runlog.first_below(rates, "checkpoint", "item_id", F.col("rate"), 0.3)
    return t.select("checkpoint", F.coalesce("first_at", F.lit(-1)).cast("bigint").alias("first_item"), r6(F.coalesce("first_value", F.lit(-1.0))).alias("first_rate"))


@query("q52", """
SELECT run_id, lower(trim(r.status)) AS status, round(CASE WHEN r.ended_at IS NULL OR r.started_at IS NULL THEN -1 ELSE greatest(0.0, (epoch_us(r.ended_at) - epoch_us(r.started_at)) / 1e6) END, 6)::DOUBLE AS seconds FROM
 (SELECT run_id, max({'updated_at': updated_at, 'status': status, 'started_at': started_at, 'ended_at': ended_at}) AS r FROM run_registry WHERE run_id IS NOT NULL GROUP BY 1)""")  # fmt: skip
def q52(s, d):
    """Latest state of each run and its duration; -1 while it has no end."""
    t = runlog.latest(load(s, d, "run_registry").select("run_id", "status", "started_at", "ended_at", "updated_at"), "run_id", "updated_at")
    return t.select("run_id", F.lower(F.trim("status")).alias("status"), r6(F.coalesce(runlog.duration_seconds(F.col("started_at"), F.col("ended_at")), F.lit(-1.0))).alias("seconds"))


@query("q53", f"""
SELECT metric, count(*)::BIGINT AS n, round(avg(value), 4) AS mean FROM (SELECT unnest(['train_loss', 'grad_norm', 'tokens_per_sec', 'val_next_token_loss']) AS metric, unnest([train_loss, grad_norm, tokens_per_sec, val_next_token_loss]) AS value FROM ({LOG}))
 WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1""")  # fmt: skip
def q53(s, d):
    """Metrics melted into rows, counted and averaged."""
    t = runlog.melt(_log(s, d), ["run_id", "global_step"], ["train_loss", "grad_norm", "tokens_per_sec", "val_next_token_loss"])
    return t.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), 4).alias("mean"))


@query("q54", "SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def q54(s, d):
    """Fields flattened out of JSON."""
    t = load(s, d, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return t.filter("k IS NOT NULL").groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("q55", f"""
SELECT run_id, coalesce(min(global_step) FILTER (WHERE train_loss < 6 AND grad_norm < 1 AND tokens_per_sec > 20000), -1)::BIGINT AS first_step, count(*) FILTER (WHERE train_loss < 6)::BIGINT AS n_low FROM ({LOG}) GROUP BY 1""")  # fmt: skip
def q55(s, d):
    """First step at which all conditions hold; -1 if there is none."""
    ok = (F.col("train_loss") < 6) & (F.col("grad_norm") < 1) & (F.col("tokens_per_sec") > 20000)
    return _log(s, d).groupBy("run_id").agg(F.coalesce(F.min(F.when(ok, F.col("global_step"))), F.lit(-1)).alias("first_step"), F.count_if(F.col("train_loss") < 6).alias("n_low"))


@query("q56", """
WITH c AS (SELECT i, ['transformer', 'mixer', 'compressed'][(i % 3 + 1)::BIGINT] AS kind, 64 * (1 + i % 4) AS d, 4 * 64 * (1 + i % 4) AS ff, 4 + i % 5 AS layers, 128 * (1 + i % 3) AS seq, 32768 AS vocab, 1 + i % 4 AS entries, 16 AS block, i % 3 AS islands FROM range(60) t(i)),
 p AS (SELECT *, 8 * d * d AS att, 4 * seq * d AS sc, 6 * d * ff AS f, 8 * d * d + 10 * d AS m, 2 * d * vocab AS head, entries / block::DOUBLE AS ratio FROM c)
SELECT i::BIGINT AS config, kind, (CASE kind WHEN 'transformer' THEN layers * (att + sc + f) WHEN 'mixer' THEN layers * (m + f)
 ELSE greatest(layers - islands, 0) * (m + f) + floor(islands * ratio * (att + sc * ratio + f)) + floor(4 * d * d / block + entries * d) END + head + floor(0.5 * head))::BIGINT AS flops FROM p""")  # fmt: skip
def q56(s, d):
    """Cost model over configurations."""
    i = F.col("id")
    t = s.range(60).select(i.alias("config"), F.element_at(F.array(*map(F.lit, ["transformer", "mixer", "compressed"])), (i % 3 + 1).cast("int")).alias("kind"), (64 * (1 + i % 4)).alias("dim"), i)
    flops = costs.flops_per_token(F.col("kind"), F.col("dim"), 4 * F.col("dim"), 4 + i % 5, 128 * (1 + i % 3), F.lit(32768), 1 + i % 4, F.lit(16), i % 3, F.lit(0.5))
    return t.select("config", "kind", flops.alias("flops"))


@query("q57", """
SELECT user_id, count(*)::BIGINT AS n, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 9)::DOUBLE AS per_second FROM events GROUP BY 1""")  # fmt: skip
def q57(s, d):
    """Rows per second of each series."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return load(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.try_divide(F.count(F.lit(1)).cast("double"), span), 9).alias("per_second"))
