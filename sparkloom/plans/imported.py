"""Queries i01 to i09: imported runs, prompts, timelines and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.text import mask_path, stable_hash
from sparkloom.operators import backfill, records, runlog, streams
from sparkloom.plans.corpus import SEED, big
from sparkloom.plans.registry import query
from sparkloom.plans.rules import LOG, RESULTS
from sparkloom.session import new_folder
from sparkloom.sources import sinks
from sparkloom.tables import load


@query("i01", """
SELECT event_type, count(*) FILTER (WHERE (starts_with(trim(props), '{') OR starts_with(trim(props), '[')) AND json_valid(trim(props)))::BIGINT AS parsed, count(*)::BIGINT AS n FROM events GROUP BY 1""")  # fmt: skip
def i01(s, d):
    """Texts that spell a list or an object, and all others, which stay texts."""
    t = load(s, d, "events").select("event_type", backfill.maybe_json(F.col("props")).alias("v"))
    return t.groupBy("event_type").agg(F.count("v").alias("parsed"), F.count(F.lit(1)).alias("n"))


_PROMPT = """'<|system|>' || chr(10) || coalesce(system, 'S') || chr(10) || CASE WHEN coalesce(repo_context, '') <> '' THEN chr(10) || '<|repo_context|>' || chr(10) || repo_context || chr(10) ELSE '' END
 || coalesce(array_to_string(list_transform(messages, lambda m: chr(10) || '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || coalesce(m.content, '') || chr(10)), ''), '') || chr(10) || '<|assistant|>' || chr(10)"""


@query("i02", f"SELECT DISTINCT record_id, substr(sha256({_PROMPT}), 1, 16) AS prompt FROM agentcoder_coding_ladder_sft")
def i02(s, d):
    """Prompts up to where the assistant is to answer."""
    return load(s, d, "agentcoder_coding_ladder_sft").select("record_id", stable_hash(records.render_prompt("S")).alias("prompt")).distinct()


@query("i03", f"""
WITH t AS (SELECT DISTINCT m.content AS text FROM (SELECT unnest(messages) AS m FROM agentcoder_coding_ladder_sft WHERE messages IS NOT NULL) WHERE m.role = 'user'),
 p AS (SELECT DISTINCT record_id, {_PROMPT} AS p FROM agentcoder_coding_ladder_sft), u AS (SELECT record_id, trim(split_part(substr(p, instr(p, '<|user|>' || chr(10)) + 9), chr(10) || chr(10) || '<|assistant|>', 1), E' \\n\\t\\r') AS u FROM p WHERE contains(p, '<|user|>' || chr(10)))
SELECT count(*)::BIGINT AS n_prompts, count(*) FILTER (WHERE u IN (SELECT trim(text, E' \\n\\t\\r') FROM t WHERE text IS NOT NULL))::BIGINT AS n_trained FROM u""")  # fmt: skip
def i03(s, d):
    """Users' parts cut out of rendered prompts, and how many of them are training prompts."""
    t = load(s, d, "agentcoder_coding_ladder_sft")
    trained = t.select(F.explode("messages").alias("m")).filter("m.role = 'user' AND m.content IS NOT NULL").select(F.trim(F.regexp_replace("m.content", r"^[ \n\t\r]+|[ \n\t\r]+$", "")).alias("u")).distinct()
    p = t.select("record_id", records.render_prompt("S").alias("p")).distinct().filter(F.contains("p", F.lit("<|user|>\n"))).select("record_id", records.user_prompt(F.col("p")).alias("u"))
    return p.join(trained.withColumn("hit", F.lit(True)), "u", "left").agg(F.count(F.lit(1)).alias("n_prompts"), F.count("hit").alias("n_trained"))


def _folders(s, d) -> str:
    """A folder per run with its summary and the log of its validation steps."""
    folder = new_folder(s, "imported")
    log = runlog.clean_log(load(s, d, "train_log")).filter("val_next_token_loss IS NOT NULL").select("run_id", "global_step", "val_next_token_loss", F.lit(True).alias("kept"), F.lit("x").alias("note"))
    lines = log.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("global_step", "val_next_token_loss", "kept", "note")))), "\n").alias("text"))  # the validation steps of a run are few
    runs = load(s, d, "run_registry").filter("run_id IS NOT NULL").groupBy("run_id").agg(F.max(F.coalesce(F.try_element_at("params", F.lit("mixer")), F.lit(""))).alias("mixer"))
    summary = F.concat(F.lit('{"run": {"mixer": "'), F.col("mixer"), F.lit('", "depth": {"n": 3}}, "list": [1], "ok": true}'))
    sinks.write_files(
        lines.select(F.concat("run_id", F.lit("/train/train_log.jsonl")).alias("name"), F.concat("text", F.lit("\nbroken {\n")).alias("text"))
        .unionByName(runs.select(F.concat("run_id", F.lit("/summary.json")).alias("name"), summary.alias("text")))
        .unionByName(runs.select(F.concat("run_id", F.lit("/agentic_eval.json")).alias("name"), F.lit('{"passed": 7, "all": false, "who": "x"}').alias("text"))),
        folder,
    )
    return folder


@query("i04", f"""
SELECT run_id, 'val_next_token_loss' AS metric, count(*)::BIGINT AS n, round(sum(val_next_token_loss), 6) AS total, sum(global_step)::BIGINT AS steps FROM ({LOG}) WHERE val_next_token_loss IS NOT NULL GROUP BY 1
UNION ALL SELECT run_id, 'kept', count(*), count(*)::DOUBLE, sum(global_step)::BIGINT FROM ({LOG}) WHERE val_next_token_loss IS NOT NULL GROUP BY 1
UNION ALL SELECT DISTINCT run_id, unnest(['eval.passed', 'eval.all']), 1, unnest([7.0, 0.0]), 0 FROM run_registry WHERE run_id IS NOT NULL""")  # fmt: skip
def i04(s, d):
    """Metrics of imported run folders: numbers and flags of the logs and the evaluations; broken lines are lost."""
    m = backfill.metrics(s, _folders(s, d))
    return m.groupBy(F.element_at(F.split("run_dir", "/"), -1).alias("run_id"), "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.coalesce(F.sum("step"), F.lit(0)).alias("steps"))


@query("i05", """
SELECT run_id, unnest(['summary.ok', 'summary.run.depth.n', 'summary.run.mixer']) AS key, unnest(['true', '3', mixer]) AS value FROM (SELECT run_id, max(coalesce(params['mixer'], '')) AS mixer FROM run_registry WHERE run_id IS NOT NULL GROUP BY 1)""")  # fmt: skip
def i05(s, d):
    """Parameters of imported run folders, under dotted names."""
    p = backfill.parameters(s, _folders(s, d))
    return p.select(F.element_at(F.split("run_dir", "/"), -1).alias("run_id"), F.explode("params").alias("key", "value"))


@query("i06", f"""
SELECT i::BIGINT AS id, (('0x' || substr(sha256('{SEED}|' || i), 1, 15))::BIGINT % (1000003 - 2048))::BIGINT AS start FROM range(4096) t(i)""")  # fmt: skip
def i06(s, d):
    """Starts of the windows of random batches over a token stream."""
    return s.range(4096).select("id", streams.batch_starts(1_000_003, 2048, SEED).alias("start"))


@query("i07", f"""
WITH c AS (SELECT lower(trim(checkpoint)) AS checkpoint, count(*) FILTER (WHERE item_id % 2 = 0) AS tc, count(*) FILTER (WHERE item_id % 2 = 0 AND passed) AS tp, count(*) FILTER (WHERE item_id % 2 = 1) AS ac, count(*) FILTER (WHERE item_id % 2 = 1 AND passed) AS ap FROM ({RESULTS}) GROUP BY 1, run_id)
SELECT count(*)::BIGINT AS checkpoints, coalesce(min(checkpoint) FILTER (WHERE tc > 0 AND tp = tc), '') AS first_targets, coalesce(min(checkpoint) FILTER (WHERE tc > 0 AND tp = tc AND ac > 0 AND ap = ac), '') AS first_all, coalesce(max(tp), 0)::BIGINT AS best_target, coalesce(max(ap), 0)::BIGINT AS best_anchor FROM c""")  # fmt: skip
def i07(s, d):
    """When all targets and anchors first pass, over all checkpoints of all runs by name."""
    t = load(s, d, "eval_results").distinct().withColumn("checkpoint", F.lower(F.trim("checkpoint")))
    even = F.col("item_id") % 2 == 0
    c = t.groupBy("checkpoint", "run_id").agg(F.count_if(even).alias("target_cases"), F.count_if(even & F.col("passed")).alias("target_passed"), F.count_if(F.col("item_id") % 2 == 1).alias("anchor_cases"), F.count_if((F.col("item_id") % 2 == 1) & F.col("passed")).alias("anchor_passed"))
    out = runlog.timeline(c.withColumn("place", F.col("checkpoint")), "place", "checkpoint")
    return out.withColumns({n: F.coalesce(n, F.lit("")) for n in ("first_targets", "first_all")})


@query("i08", f"""
WITH l AS (SELECT run_id, global_step, CASE WHEN global_step % 700 = 0 THEN 0.5 END AS scale, CASE WHEN global_step % 1100 = 0 THEN 0.25 END AS new_scale, next_token_loss + CASE WHEN val_next_token_loss IS NULL THEN 0 ELSE 0.1 * val_next_token_loss END + 0.3 * train_loss AS total FROM ({LOG}))
SELECT run_id, coalesce(max({{'s': global_step, 'v': coalesce(new_scale, scale)}}) FILTER (WHERE scale IS NOT NULL OR new_scale IS NOT NULL).v, 1.0)::DOUBLE AS scale, round(avg(total), 6) AS mean_total FROM l GROUP BY 1""")  # fmt: skip
def i08(s, d):
    """The learning-rate scale each run would resume with, and its mean weighted loss."""
    t = runlog.clean_log(load(s, d, "train_log"))
    total = runlog.total_loss(F.col("next_token_loss"), F.col("val_next_token_loss"), F.lit(0.1), [(F.when(F.col("train_loss").isNotNull(), F.col("train_loss")), F.lit(0.3)), (F.col("grad_norm"), F.lit(0.0))])
    t = t.withColumns({"scale": F.when(F.col("global_step") % 700 == 0, 0.5), "new_scale": F.when(F.col("global_step") % 1100 == 0, 0.25), "total": F.when(F.col("train_loss").isNotNull(), total)})
    return runlog.last_scale(t, "global_step", "scale", "new_scale").join(t.groupBy("run_id").agg(F.round(F.avg("total"), 6).alias("mean_total")), "run_id")


@query("i09", "SELECT item_id, name || '_loss_mask.bin' AS mask, name || '_loss_mask' AS bare FROM benchmark WHERE name IS NOT NULL AND NOT contains(name, '.')")
def i09(s, d):
    """Names of the loss masks beside token files."""
    t = load(s, d, "benchmark").filter("name IS NOT NULL AND NOT contains(name, '.')")
    return t.select("item_id", mask_path(F.concat("name", F.lit(".bin"))).alias("mask"), mask_path(F.col("name")).alias("bare"))
