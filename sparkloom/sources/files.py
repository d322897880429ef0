"""Readers of text, JSON lines, case files, binary token files and run folders."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes read from a folder, whatever their case. A file named outright may have any.
TEXT_SUFFIXES = (
    "txt",
    "md",
    "jsonl",
    "json",
    "py",
    "js",
    "ts",
    "tsx",
    "jsx",
    "sh",
    "yaml",
    "yml",
    "toml",
    "diff",
    "patch",
    "log",
)
RECORD = "system string, repo_context string, messages array<struct<role:string,content:string>>, trace array<struct<type:string,content:string>>, final string, text string"
#: Columns of an evaluation case; JSON values of any shape stay JSON text.
CASE = (
    "name string, topic string, prompt string, required_substrings array<string>, forbidden_substrings array<string>, expected_behavior string, slot_family string, eval_tier string, max_completion_chars int, "
    "expected_json string, strict_json boolean, expected_slots map<string,string>, expected_key_sequence array<string>, python_function string, python_assert_tests array<string>, python_syntax boolean, "
    "expected_patch struct<path:string,removed:string,added:string>, no_trailing_text boolean, no_nonsense boolean"
)


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _any_case(suffixes: tuple[str, ...]) -> str:
    """Glob of files with one of the suffixes in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text), one row per file of the known suffixes; folders are searched throughout; manifest.json is skipped.

    A path with a suffix is taken as a file whatever the suffix is.
    """
    named = [p for p in _paths(paths) if os.path.splitext(p)[1]]
    folders = [p for p in _paths(paths) if not os.path.splitext(p)[1]]
    out = None
    for group, options in ((named, {}), (folders, {"recursiveFileLookup": "true", "pathGlobFilter": _any_case(TEXT_SUFFIXES)})):
        if group:
            part = spark.read.options(**options).text(group, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "path string, text string")
    return out.filter(_name(F.col("path")) != "manifest.json")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, value) of JSON lines files; line counts from 1 in each file, blank lines included.

    A large file lies in several splits. The lines of each split are counted
    first; a line's number is its place in its split after the lines of the
    splits before. Only the counts meet in a window, a row per split.
    """
    named = [p for p in _paths(paths) if p.lower().endswith(".jsonl")]  # a file, or a table that was written under this name
    folders = [p for p in _paths(paths) if not p.lower().endswith(".jsonl")]
    raw = None
    for group, options in ((named, {}), (folders, {"recursiveFileLookup": "true", "pathGlobFilter": _any_case(("jsonl",))})):
        if group:
            part = spark.read.options(**options).text(group).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
            raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        return spark.createDataFrame([], "path string, line bigint, value string")
    raw = raw.withColumn("id", F.monotonically_increasing_id())
    splits = raw.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(splits, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str = RECORD, on_error: str = "fail") -> DataFrame:
    """Rows of JSON lines with path and line number, blank lines left out.

    on_error: "fail" raises at a line that is no JSON object, "count" keeps it
    with malformed and is_json, "drop" leaves it out.
    """
    parsed = numbered_lines(spark, paths).filter(F.trim("value") != "").withColumn("__v", F.try_parse_json("value"))
    is_json = F.col("__v").isNotNull()
    good = is_json & F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT"))
    fields = T._parse_datatype_string(schema).fieldNames() if not isinstance(schema, T.StructType) else schema.fieldNames()
    rows = parsed.withColumns({"malformed": ~good, "is_json": is_json, "r": F.from_json("value", schema)})
    if on_error == "fail":
        rows = rows.withColumn("r", F.when(F.col("malformed"), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).otherwise(F.col("r")))
    elif on_error == "drop":
        rows = rows.filter(~F.col("malformed"))
    extra = [F.col("malformed"), F.col("is_json"), F.col("__v").alias("value")] if on_error == "count" else []
    return rows.select("path", "line", *extra, *[F.col(f"r.{f}").alias(f) for f in fields])


def real_records(spark: SparkSession, paths: str | list[str], longest: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, counts): the structured records of JSON lines, and a row that accounts for every line.

    counts: files, lines (not blank), json_errors, plain_text (no object, or
    with a text), structured, skipped_long. A structured record longer than
    ``longest`` characters without tags is skipped; 0 sets no limit. Kept
    records name their file and line in _curriculum_source.
    """
    from sparkloom.operators.records import is_structured, render_plain

    rows = json_lines(spark, paths, on_error="count")
    structured = ~F.col("malformed") & is_structured(rows)
    long = (F.length(render_plain()) > longest) if longest else F.lit(False)
    kind = F.when(~F.col("is_json"), "json_error").when(~structured, "plain_text").when(long, "skipped_long").otherwise("kept")
    rows = rows.withColumn("__kind", kind)
    one = lambda *k: F.count_if(F.col("__kind").isin(*k))
    counts = rows.agg(
        F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("lines"), one("json_error").alias("json_errors"), one("plain_text").alias("plain_text"), one("kept", "skipped_long").alias("structured"), one("skipped_long").alias("skipped_long")
    )
    kept = rows.filter("__kind = 'kept'").withColumn("_curriculum_source", F.concat("path", F.lit(":"), F.col("line").cast("string")))
    return kept.drop("__kind", "malformed", "is_json", "value"), counts


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, text, hash): rendered records of the JSON lines and whole texts of other files; malformed lines raise."""
    from sparkloom.functions.text import stable_hash
    from sparkloom.operators.records import render

    records = json_lines(spark, paths).select(F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("source"), render().alias("text"))
    plain = text_files(spark, paths).filter(~F.lower("path").endswith(".jsonl")).select(F.col("path").alias("source"), "text")
    return records.unionByName(plain).withColumn("hash", stable_hash(F.col("text")))


def train_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a step log; a missing file is an empty table, a malformed line raises."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON file: a list, or an object with cases or prompts. A case without a prompt and an empty file raise."""
    text = spark.read.text(path, wholetext=True)
    item = f"array<{T._parse_datatype_string(CASE).simpleString()}>"
    # an object read as a list would be a list of one, so the first character decides
    whole = F.coalesce(F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", item)), F.from_json("value", f"struct<cases:{item}>")["cases"], F.from_json("value", f"struct<prompts:{item}>")["prompts"])
    cases = text.select(F.posexplode(F.when(F.size(whole) > 0, whole).otherwise(F.raise_error(F.lit("no cases")))).alias("ord", "c")).select("ord", "c.*")
    empty = F.array().cast("array<string>")
    return cases.withColumns({
        "prompt": F.coalesce("prompt", F.raise_error(F.lit("a case has no prompt"))), "name": F.coalesce("name", F.format_string("case_%03d", "ord")),
        "required_substrings": F.coalesce("required_substrings", empty), "forbidden_substrings": F.coalesce("forbidden_substrings", empty),
    })


def binary_tokens(spark: SparkSession, paths: str | list[str], width: int = 4) -> DataFrame:
    """(path, pos, token) of flat little-endian integer files of 4 or 8 bytes a token; a ragged tail is left off."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.bin").load(_paths(paths)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                buffer = content.as_buffer()
                values = np.frombuffer(buffer, "<i4" if width == 4 else "<i8", buffer.size // width)
                for first in range(0, len(values), 1 << 20):
                    part = values[first : first + (1 << 20)].astype(np.int64)
                    pos = np.arange(first, first + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(pos), pa.array(part)], ["path", "pos", "token"])

    return files.mapInArrow(run, "path string, pos bigint, token bigint")


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir) of the folders with a run's marker files.

    The folder of a step log counts, and the one above if it is called train;
    of a summary its folder; of a manifest its folder, or the one above a train.
    """
    listing = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="{train_log.jsonl,summary.json,manifest.json}").load(root)
    folder, name = F.regexp_replace("path", r"/[^/]+$", ""), _name(F.col("path"))
    above = F.when(folder.endswith("/train"), F.regexp_replace(folder, r"/train$", ""))
    dirs = F.when(name == "train_log.jsonl", F.array(folder, above)).when(name == "summary.json", F.array(folder)).otherwise(F.array(F.coalesce(above, folder)))
    return listing.select(F.explode(F.array_compact(dirs)).alias("run_dir")).distinct().orderBy("run_dir")


def artifacts(spark: SparkSession, run_dir: str) -> DataFrame:
    """(path, bytes) of the files of a run: those directly in it, its train, packed and generated folders, and its checkpoints."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run_dir)
    inside = F.regexp_extract("path", r"^.*?" + re.escape(run_dir.split("://")[-1].rstrip("/").lstrip("/")) + r"/(.*?)/?[^/]+$", 1)
    return listing.filter(inside.isin("", "train", "packed", "generated", "checkpoints", "train/checkpoints")).select("path", F.col("length").alias("bytes")).distinct().orderBy("path")


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(name, kind) of checkpoint files: step_N by number, then best, then last, then others by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pt").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.pt$", 1)
    out = files.select(name.alias("name")).withColumn("step", F.expr("try_cast(regexp_extract(name, '^step_([0-9]+)$', 1) AS bigint)"))
    rank = F.when(F.col("step").isNotNull(), 0).when(F.col("name") == "best", 1).when(F.col("name") == "last", 2).otherwise(3)
    return out.withColumn("kind", rank).orderBy("kind", "step", "name").select("name", "kind", "step")


def load_json(path: str, default=None, strict: bool = True):
    """Whole JSON file on the driver; default where it is absent, and where it is malformed unless strict."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return default
    except ValueError:
        if strict:
            raise
        return default


#: Fixed values, dependent settings: where the flag is false, the setting takes the value; a name of FOLLOWS takes the other's value where it is null.
TOGGLES = (
    ("use_dynamic_hourglass_compression", ("compression", "enabled"), False),
    ("use_curriculum_mtp", ("mtp", "enabled"), False),
    ("use_attention_islands", ("attention_island_layers",), []),
    ("use_anchor_preserved_local_global", ("compression", "anchors_per_block"), 0),
)
FOLLOWS = (("n_kv_heads", "n_heads"),)


def resolve_config(given: dict, defaults: dict) -> dict:
    """Known keys of given over defaults, then the dependent settings; unknown keys are ignored, null sections are empty."""

    def merged(d: dict, g: dict) -> dict:
        return {k: merged(v, g.get(k) or {}) if isinstance(v, dict) else (g[k] if k in g else v) for k, v in d.items()}

    out = merged(defaults, given)
    for flag, path, value in TOGGLES:
        if flag in out and not out[flag]:
            at = out
            for k in path[:-1]:
                at = at.get(k, {})
            if path[-1] in at:
                at[path[-1]] = value
    for name, like in FOLLOWS:
        if name in out and out[name] is None:
            out[name] = out.get(like)
    return out


def config_frame(spark: SparkSession, given: dict, defaults: dict, schema: str | None = None) -> DataFrame:
    """One row of a resolved configuration, nested objects as structs, with a hash of it; schema where the defaults hold nulls."""
    text = json.dumps(resolve_config(given, defaults), sort_keys=True)
    shape = F.lit(schema) if schema else F.schema_of_json(F.lit(json.dumps(defaults, sort_keys=True)))
    return spark.range(1).select(F.from_json(F.lit(text), schema or shape).alias("c"), F.substring(F.sha2(F.lit(text), 256), 1, 16).alias("hash")).select("c.*", "hash")


def cyclic_batch(stream: DataFrame, *, batch: int, rows: int, length: int) -> DataFrame:
    """(row, t, token) of the batch-th batch over a token stream (pos, token) read in a circle.

    Row r of a batch begins (batch * rows + r) * length tokens after the start; after the last token the first follows. A
    stream of fewer than two tokens raises.
    """
    n = stream.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") < 2, F.raise_error(F.lit("a token stream has at least two tokens"))).otherwise(F.col("n")).cast("bigint").alias("n"))
    asked = stream.sparkSession.range(rows * length).select(F.floor(F.col("id") / length).alias("row"), (F.col("id") % length).alias("t"), (F.col("id") + batch * rows * length).alias("at"))
    asked = asked.withColumn("one", F.lit(1)).join(F.broadcast(n.withColumn("one", F.lit(1))), "one")  # one row
    return asked.select("row", "t", F.pmod("at", "n").alias("pos")).join(stream.select("pos", "token"), "pos").select("row", "t", "token")


def byte_stream(texts: DataFrame, text: str = "text") -> DataFrame:
    """(pos, token): the bytes of one text, a row per byte."""
    digits = F.hex(F.col(text).cast("binary"))
    return texts.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def synthetic_tokens(spark: SparkSession, rows: int, length: int, vocab: int, counter: int = 0, seed: int = 17) -> DataFrame:
    """(row, pos, token): a deterministic pattern with hashed noise, its first half copied to its second."""
    g = spark.range(rows * length).select(F.floor(F.col("id") / length).alias("row"), (F.col("id") % length).alias("pos"))
    half = length // 2
    src = F.when(F.col("pos") >= half, F.col("pos") - half).otherwise(F.col("pos"))
    noise = F.pmod(F.xxhash64(F.lit(seed), "row", src), F.lit(3))
    return g.select("row", "pos", ((7 * src + 13 * F.col("row") + counter + noise) % vocab).alias("token"))
