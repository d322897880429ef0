"""Streams, folds and Python functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sparkloom.functions import python_udfs as u
from sparkloom.functions.text import extract_fenced
from sparkloom.operators import runlog, tokens
from sparkloom.plans.corpus import VOCAB, vocabulary
from sparkloom.plans.registry import query
from sparkloom.plans.rules import LOG
from sparkloom.session import new_folder
from sparkloom.streaming import logs
from sparkloom.tables import load, spread


_FOLD = """
WITH RECURSIVE v AS (SELECT run_id, s, v, row_number() OVER (PARTITION BY run_id ORDER BY s) AS rn FROM ({rows})),
 f AS (SELECT DISTINCT run_id, 0::BIGINT AS rn, 'Infinity'::DOUBLE AS best, 0::BIGINT AS streak, 1.0::DOUBLE AS scale, {never}::BIGINT AS stop FROM v UNION ALL
 SELECT f.run_id, v.rn, CASE WHEN {stopped} THEN best ELSE least(best, v.v) END, CASE WHEN {stopped} THEN streak WHEN v.v < best - 0.01 THEN 0 ELSE streak + 1 END,
 CASE WHEN NOT ({stopped}) AND v.v >= best - 0.01 AND streak + 1 >= 3 THEN scale * 0.5 ELSE scale END, CASE WHEN NOT ({stopped}) AND v.v >= best - 0.01 AND streak + 1 >= 3 THEN v.s ELSE stop END FROM f JOIN v ON v.run_id = f.run_id AND v.rn = f.rn + 1)
SELECT run_id, round(best, 9) AS best, streak, scale, stop FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rn DESC) AS k FROM f) WHERE k = 1"""


@query("st01", """
SELECT strftime(logged_at, '%Y-%m-%d') AS day, run_id, count(*)::BIGINT AS n, max(global_step) AS last_step, round(min(train_loss), 9) AS best_loss FROM train_log WHERE run_id IS NOT NULL AND logged_at IS NOT NULL AND coalesce(train_loss::VARCHAR <> 'nan', TRUE) GROUP BY 1, 2""")  # fmt: skip
def st01(s, d):
    """Log rows tailed as a stream and aggregated per run and day."""
    folder = new_folder(s, "stream")
    schema = load(s, d, "train_log").schema
    logs.drain(logs.live_summary(logs.tail(s, _folder(d), schema, "parquet")), folder, "update", keep="day")
    out = s.read.parquet(folder).groupBy("day", "run_id").agg(F.max_by(F.struct("n", "last_step", "best_loss"), "__batch").alias("r"))
    return out.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "run_id", "r.n", "r.last_step", F.round("r.best_loss", 9).alias("best_loss"))


def _folder(d: str) -> str:
    return f"{d}/train_log.parquet" if os.path.isdir(f"{d}/train_log.parquet") else f"{d}/train_log*.parquet"


@query("st02", _FOLD.format(never="-1", stopped="stop >= 0", rows="SELECT run_id, global_step AS s, min(val_next_token_loss) AS v FROM train_log WHERE run_id IS NOT NULL AND global_step IS NOT NULL AND val_next_token_loss::VARCHAR <> 'nan' GROUP BY 1, 2"))
def st02(s, d):
    """Early stop of every run, folded over a stream; equal to the batch fold of u00."""
    folder = new_folder(s, "stream")
    log = logs.tail(s, _folder(d), load(s, d, "train_log").schema, "parquet")
    logs.drain(logs.early_stop(log, min_delta=0.01, patience=3), folder, "update", keep="run_id")
    out = s.read.parquet(folder).groupBy("run_id").agg(F.max_by(F.struct("best", "streak", "scale", "stop"), "__batch").alias("r"))
    return out.select("run_id", F.round("r.best", 9).alias("best"), "r.streak", "r.scale", "r.stop")


@query("u00", _FOLD.format(never="NULL", stopped="stop IS NOT NULL", rows=f"SELECT run_id, global_step AS s, val_next_token_loss AS v FROM ({LOG}) WHERE val_next_token_loss IS NOT NULL"))
def u00(s, d):
    """Batch twin of st02."""
    return runlog.early_stop(runlog.clean_log(load(s, d, "train_log")), "val_next_token_loss", min_delta=0.01, patience=3).withColumn("best", F.round("best", 9))


@query("u01")
def u01(s, d):
    """Syntax and first function name of the fenced code in documents."""
    t = load(s, d, "documents").select("doc_id", extract_fenced(F.col("text")).alias("code")).filter("code IS NOT NULL")
    return t.select("doc_id", u.python_syntax_ok("code").alias("ok"), u.first_function_name("code").alias("name"))


@query("u02")
def u02(s, d):
    """Unified diff between a record's context and its fenced answer."""
    t = load(s, d, "agentcoder_slice_train").select("record_id", extract_fenced(F.col("repo_context")).alias("old"), extract_fenced(F.array_join("trace.content", "\n")).alias("new"))
    t = t.filter("old IS NOT NULL AND new IS NOT NULL").groupBy("record_id").agg(F.min(F.struct("old", "new")).alias("r")).select("record_id", "r.old", "r.new")  # the least of deliveries that differ
    return t.select("record_id", F.array_join(u.unified_diff(F.lit("file.py"), "old", "new"), "\n").alias("diff"))


@query("u03")
def u03(s, d):
    """First JSON object embedded in each document."""
    return load(s, d, "documents").select("doc_id", u.first_json_object("text").alias("json")).filter("json IS NOT NULL")


@query("u04", "SELECT doc_id, TRUE AS same FROM documents WHERE text IS NOT NULL")
def u04(s, d):
    """Documents whose decoded ids spell the text again."""
    docs, vocab = spread(load(s, d, "documents").select("doc_id", "text").filter("text IS NOT NULL")), tokens.with_specials(vocabulary(s, d))
    back = tokens.decode(tokens.encode_documents(docs, "doc_id", "text", vocab, VOCAB), "doc_id", vocab, VOCAB)
    t = docs.select("doc_id", "text").join(back.select("doc_id", u.decode_tokens("tokens").alias("decoded")), "doc_id", "left")
    return t.select("doc_id", (F.coalesce("decoded", F.lit("")) == F.col("text")).alias("same"))


@query("u05", "SELECT n_nationkey, n_nationkey % 2 = 0 AS passed FROM nation")
def u05(s, d):
    """Tests run on functions made here, one in two of them wrong; the runner is off unless it is asked for."""
    n = F.col("n_nationkey").cast("string")
    code = F.concat(F.lit("def f(x):\n    return x + "), n)
    tests = F.concat(F.lit("assert f(1) == 1 + "), n, F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(" + 1"))
    return load(s, d, "nation").select("n_nationkey", u.test_runner(enabled=True)(code, tests).alias("passed"))


@query("u06", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS rate FROM nation")
def u06(s, d):
    """Patches that apply to a fixed file, and such with another path, another old line or no hunk."""
    mode = F.col("n_nationkey") % 4
    path, old = F.when(mode == 1, "other.py").otherwise("file.py"), F.when(mode == 2, "    return b-a").otherwise("    return a-b")
    hunk = F.when(mode == 3, "").otherwise(F.concat(F.lit("@@ -1,2 +1,2 @@\n def add(a,b):\n-"), old, F.lit("\n+    return a+"), F.col("n_nationkey").cast("string"), F.lit("\n")))
    patch = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), hunk)
    return load(s, d, "nation").select("n_nationkey", u.patch_check({"file.py": "def add(a,b):\n    return a-b\n"})(patch).alias("rate"))
