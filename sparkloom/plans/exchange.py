"""Queries f01 to f14: files are written from the tables into the shared folder, and read back by the sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.text import stable_hash
from sparkloom.plans.corpus import MOST_CHARS, big
from sparkloom.plans.registry import query
from sparkloom.plans.rules import RENDERED
from sparkloom.session import new_folder
from sparkloom.sources import files, sinks
from sparkloom.tables import load

_SUFFIX = ["txt", "MD", "bin", "yaml", "Patch"]
_NAME = "CASE WHEN item_id % 50 = 0 THEN 'm' || item_id || '/manifest.json' ELSE 'd' || (item_id % 3) || '/' || item_id || '.' || ['txt', 'MD', 'bin', 'yaml', 'Patch'][(item_id % 5 + 1)::BIGINT] END"


def _base(c) -> F.Column:
    return F.element_at(F.split(c, "/"), -1)


def _named(s, d):
    t = load(s, d, "benchmark")
    plain = F.concat(F.lit("d"), (F.col("item_id") % 3).cast("string"), F.lit("/"), F.col("item_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _SUFFIX)), (F.col("item_id") % 5 + 1).cast("int")))
    return t.select(F.when(F.col("item_id") % 50 == 0, F.concat(F.lit("m"), F.col("item_id").cast("string"), F.lit("/manifest.json"))).otherwise(plain).alias("name"), "text")


@query("f01", f"""
SELECT regexp_extract({_NAME}, '[^/]*$') AS name, substr(sha256(text), 1, 16) AS hash FROM benchmark WHERE item_id % 50 <> 0 AND item_id % 5 <> 2""")  # fmt: skip
def f01(s, d):
    """Files of a folder tree with the known suffixes in any case; manifests are skipped."""
    folder = new_folder(s, "files")
    sinks.write_files(_named(s, d), folder)
    t = files.text_files(s, folder)
    return t.select(_base(F.col("path")).alias("name"), stable_hash(F.col("text")).alias("hash"))


def _numbered(s, d) -> str:
    """A folder with items.jsonl, a blank line after every seventh item, and a file beside it."""
    folder = new_folder(s, "documents")
    t = load(s, d, "benchmark")
    lines = t.withColumn("rn", F.row_number().over(Window.orderBy("item_id")))  # a table of fixed size
    line = F.concat(F.to_json(F.struct("text", F.col("name").alias("extra"))), F.when(F.col("rn") % 7 == 0, "\n").otherwise(""))
    whole = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    sinks.write_files(whole.select(F.lit("a/items.jsonl").alias("name"), "text").unionByName(t.filter("item_id % 10 = 0").select(F.concat(F.lit("b/"), F.col("item_id").cast("string"), F.lit(".md")).alias("name"), "text")), folder)
    return folder


@query("f02", """
SELECT 'items.jsonl:' || (rn + (rn - 1) // 7) AS source, substr(sha256(text), 1, 16) AS hash FROM (SELECT text, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark)
UNION ALL SELECT item_id || '.md', substr(sha256(text), 1, 16) FROM benchmark WHERE item_id % 10 = 0""")  # fmt: skip
def f02(s, d):
    """Documents of JSON lines, named by file and line, and of whole files."""
    return files.documents(s, _numbered(s, d)).select(_base(F.col("source")).alias("source"), "hash")


def _broken(s, d) -> str:
    """The agent records as JSON lines; of ten, one is cut off and one is no object."""
    folder = f"{new_folder(s, 'records')}/records.jsonl"
    t = load(s, d, "agentcoder_slice_train")
    whole = F.to_json(F.struct("system", "repo_context", "messages", "trace", "final", "text", "behavior"))
    line = F.when(F.col("record_id") % 10 == 0, F.concat(F.substring(whole, 1, 12), F.lit("!"))).when(F.col("record_id") % 10 == 1, "[1, 2]").otherwise(whole)
    t.select(line.alias("value")).write.text(folder)
    return folder


_STRUCTURED = "text IS NULL AND (messages IS NOT NULL OR trace IS NOT NULL OR final IS NOT NULL OR repo_context IS NOT NULL OR system IS NOT NULL)"


@query("f03", f"""
SELECT count(*)::BIGINT AS lines, count(*) FILTER (WHERE record_id % 10 = 0)::BIGINT AS json_errors, count(*) FILTER (WHERE record_id % 10 = 1 OR (record_id % 10 > 1 AND NOT ({_STRUCTURED})))::BIGINT AS plain_text,
 count(*) FILTER (WHERE record_id % 10 > 1 AND {_STRUCTURED})::BIGINT AS structured, count(*) FILTER (WHERE record_id % 10 > 1 AND {_STRUCTURED} AND length(plain) > {MOST_CHARS})::BIGINT AS skipped_long FROM ({RENDERED})""")  # fmt: skip
def f03(s, d):
    """What becomes of every line of a tolerant scan."""
    return files.real_records(s, _broken(s, d), MOST_CHARS)[1].drop("files")


@query("f04", "SELECT topic, count(*)::BIGINT AS n, coalesce(sum(length(final)), 0)::BIGINT AS chars, coalesce(sum(len(messages)), 0)::BIGINT AS turns FROM agentcoder_coding_ladder_sft GROUP BY 1")
def f04(s, d):
    """Ladder records written as JSON lines without a private column, and scanned strictly."""
    folder = f"{new_folder(s, 'strict')}/ladder.jsonl"
    sinks.write_json_lines(load(s, d, "agentcoder_coding_ladder_sft").select("topic", "messages", "final", "_ladder_repeat"), folder, drop=("_ladder_repeat",))
    t = files.json_lines(s, folder, f"topic string, {files.RECORD}")
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), big(F.coalesce(F.sum(F.length("final")), F.lit(0))).alias("chars"), big(F.coalesce(F.sum(F.size("messages")), F.lit(0))).alias("turns"))


@query("f05", "SELECT behavior, count(*)::BIGINT AS n, count(text)::BIGINT AS n_plain FROM agentcoder_slice_train WHERE record_id % 10 > 1 GROUP BY 1")
def f05(s, d):
    """Lossy scan: broken lines and lines that are no object are left out."""
    t = files.json_lines(s, _broken(s, d), f"behavior string, {files.RECORD}", on_error="drop")
    return t.groupBy("behavior").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_plain"))


@query("f06", """
SELECT run_id, count(*)::BIGINT AS n, coalesce(sum(global_step), 0)::BIGINT AS steps, count(*) FILTER (WHERE train_loss = 'NaN'::DOUBLE)::BIGINT AS n_nan, round(coalesce(max(train_loss) FILTER (WHERE train_loss < 'NaN'::DOUBLE), -1), 6) AS worst FROM train_log GROUP BY 1""")  # fmt: skip
def f06(s, d):
    """A step log written as JSON and scanned with a fixed schema; a missing log is empty."""
    folder = new_folder(s, "log")
    t = load(s, d, "train_log").select("run_id", "global_step", "train_loss")
    schema = "run_id string, global_step bigint, train_loss double"
    t.write.json(folder)
    both = files.train_log(s, folder, schema).unionByName(files.train_log(s, f"{folder.split('://')[-1]}/missing", schema))
    nan = F.isnan("train_loss")
    return both.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("global_step"), F.lit(0)).alias("steps"), F.count_if(nan).alias("n_nan"), F.round(F.coalesce(F.max(F.when(~nan, F.col("train_loss"))), F.lit(-1.0)), 6).alias("worst")
    )


def _stream(s, d):
    """A token stream read back from int32 files: (pos, token)."""
    folder = new_folder(s, "tokens")
    t = load(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(50257)).cast("int").alias("token"))
    sinks.write_token_parts(t, folder, 8)
    parts = files.binary_tokens(s, folder)
    sizes = parts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    return parts.join(sizes.select("path", F.coalesce(before, F.lit(0)).alias("before")), "path").select((F.col("before") + F.col("pos")).alias("pos"), "token")


_POS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, ((o_custkey * 7 + o_orderkey) % 50257)::INT AS token FROM orders"


@query("f07", f"SELECT count(*)::BIGINT AS n, sum(token)::BIGINT AS total, sum((pos % 1009) * token)::BIGINT AS weighted FROM ({_POS})")
def f07(s, d):
    """A flat int32 token stream written in parts and read back in order."""
    return _stream(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("token").alias("total"), F.sum(F.pmod("pos", F.lit(1009)) * F.col("token")).alias("weighted"))


@query("f08", f"""
SELECT (i // 512)::BIGINT AS row, (i % 512)::BIGINT AS t, token::BIGINT AS token FROM (SELECT i, (i + 7 * 16 * 512) % (SELECT count(*) FROM orders) AS pos FROM range(16 * 512) r(i)) JOIN ({_POS}) USING (pos)""")  # fmt: skip
def f08(s, d):
    """The eighth batch of a binary stream that is read in a circle."""
    return files.cyclic_batch(_stream(s, d), batch=7, rows=16, length=512)


@query("f09", """
WITH b AS (SELECT hex(encode(text)) AS h FROM benchmark ORDER BY item_id LIMIT 1)
SELECT (i // 64)::BIGINT AS row, (i % 64)::BIGINT AS t, ('0x' || substr(h, (2 * ((i + 3 * 8 * 64) % (length(h) // 2)) + 1)::BIGINT, 2))::BIGINT AS token FROM b, range(8 * 64) r(i)""")  # fmt: skip
def f09(s, d):
    """A batch of a text file's bytes, read in a circle."""
    one = load(s, d, "benchmark").orderBy("item_id").limit(1)
    return files.cyclic_batch(files.byte_stream(one.select("text")), batch=3, rows=8, length=64).withColumn("token", big("token"))


@query("f10", """
SELECT name, text AS prompt, coalesce(array_to_string(required_substrings, '|'), '') AS required, '' AS forbidden, eval_tier, slot_family, max_completion_chars::BIGINT AS longest, '{"id":' || item_id || '}' AS expected_json, item_id % 2 = 0 AS strict_json FROM benchmark WHERE text IS NOT NULL""")  # fmt: skip
def f10(s, d):
    """Evaluation cases written to a case file and read with their whole schema and defaults."""
    path = f"{new_folder(s, 'cases')}/cases.json"
    t = load(s, d, "benchmark").filter("text IS NOT NULL")
    sinks.write_cases(t.select("name", F.col("text").alias("prompt"), "required_substrings", "eval_tier", "slot_family", "max_completion_chars", F.struct(F.col("item_id").alias("id")).alias("expected_json"), (F.col("item_id") % 2 == 0).alias("strict_json")), path)
    c = files.eval_cases(s, path)
    return c.select("name", "prompt", F.array_join("required_substrings", "|").alias("required"), F.array_join("forbidden_substrings", "|").alias("forbidden"), "eval_tier", "slot_family", big("max_completion_chars").alias("longest"), "expected_json", "strict_json")


@query("f11", """
SELECT FALSE AS compressed, 0::BIGINT AS anchors, TRUE AS mtp, 0::BIGINT AS islands, 6::BIGINT AS kv_heads, 128::BIGINT AS dim""")  # fmt: skip
def f11(s, d):
    """A configuration over defaults, with the settings that follow from others; unknown keys are ignored."""
    defaults = {
        "dim": 64, "n_heads": 4, "n_kv_heads": None, "attention_island_layers": [2, 5], "use_dynamic_hourglass_compression": True, "use_curriculum_mtp": True, "use_attention_islands": True, "use_anchor_preserved_local_global": True,
        "compression": {"enabled": True, "anchors_per_block": 4}, "mtp": {"enabled": True},
    }
    given = {"dim": 128, "n_heads": 6, "unknown": 1, "use_dynamic_hourglass_compression": False, "use_attention_islands": False, "use_anchor_preserved_local_global": False, "mtp": None}
    schema = "dim int, n_heads int, n_kv_heads int, attention_island_layers array<int>, compression struct<enabled:boolean,anchors_per_block:int>, mtp struct<enabled:boolean>"
    t = files.config_frame(s, given, defaults, schema)
    return t.select(F.col("compression.enabled").alias("compressed"), big("compression.anchors_per_block").alias("anchors"), F.col("mtp.enabled").alias("mtp"), big(F.size("attention_island_layers")).alias("islands"), big("n_kv_heads").alias("kv_heads"), big("dim").alias("dim"))


def _runs(s, d) -> str:
    folder = new_folder(s, "runs")
    t = load(s, d, "run_registry").filter("run_id IS NOT NULL").select("run_id").distinct()
    sinks.write_files(
        t.select(F.concat("run_id", F.lit("/train/train_log.jsonl")).alias("name"), F.lit("{}").alias("text"))
        .unionByName(t.select(F.concat("run_id", F.lit("/summary.json")), F.lit("{}")).toDF("name", "text"))
        .unionByName(t.select(F.concat("run_id", F.lit("/deep/manifest.json")), F.lit("{}")).toDF("name", "text"))
        .unionByName(t.select(F.explode(F.array(*[F.concat("run_id", F.lit(f"/checkpoints/{n}.pt")) for n in ("step_10", "step_9", "last", "best", "extra")])).alias("name"), F.lit("12345").alias("text"))),
        folder,
    )
    return folder


@query("f12", """
WITH r AS (SELECT DISTINCT run_id FROM run_registry WHERE run_id IS NOT NULL)
SELECT run_id || s AS run_dir FROM r, (SELECT unnest(['', '/train', '/deep']) AS s)""")  # fmt: skip
def f12(s, d):
    """Run folders told by their marker files."""
    folder = _runs(s, d)
    return files.run_folders(s, folder).select(F.substring_index("run_dir", "/runs-", -1).alias("run_dir")).select(F.expr("substr(run_dir, instr(run_dir, '/') + 1)").alias("run_dir"))


@query("f13", """
SELECT unnest(['step_9', 'step_10', 'best', 'last', 'extra']) AS name, unnest(range(1, 6))::BIGINT AS place, 1 + 5 AS n_artifacts""")  # fmt: skip
def f13(s, d):
    """Checkpoints of a run in their order, and the number of its artifacts."""
    folder = _runs(s, d)
    run = load(s, d, "run_registry").filter("run_id IS NOT NULL").agg(F.min("run_id")).collect()[0][0]
    n = files.artifacts(s, f"{folder}/{run}").count()
    t = files.checkpoints(s, f"{folder}/{run}/checkpoints").withColumn("place", F.row_number().over(Window.orderBy("kind", "step", "name")))  # the files of one run
    # one step log below train, one summary, five checkpoints; the manifest lies deeper than artifacts are looked for
    return t.select("name", big("place").alias("place"), F.lit(n - 1).alias("n_artifacts"))


@query("f14", """
WITH t AS (SELECT eval_tier, count(*) AS n, max(max_completion_chars) AS longest FROM benchmark GROUP BY 1)
SELECT 1::BIGINT AS part, '| eval_tier | n | longest |' AS line UNION ALL SELECT 2, '| --- | --- | --- |' UNION ALL SELECT 3, '| ' || coalesce(eval_tier, '') || ' | ' || n || ' | ' || coalesce(longest::VARCHAR, '') || ' |' FROM t""")  # fmt: skip
def f14(s, d):
    """Lines of a Markdown report."""
    t = load(s, d, "benchmark").groupBy("eval_tier").agg(F.count(F.lit(1)).alias("n"), F.max("max_completion_chars").alias("longest"))
    lines = sinks.markdown(t).rstrip("\n").split("\n")
    return s.createDataFrame([(min(i, 2) + 1, x) for i, x in enumerate(lines)], "part bigint, line string")
