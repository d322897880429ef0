"""Importing folders of finished runs: parameters, metrics and artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.runlog import infer_model_name, stable_run_id
from sparkloom.sources import files

#: Levels of nesting that flatten_json takes apart; deeper objects are left out.
DEPTH = 8
#: Files of a run's evaluations.
EVALUATIONS = ("agentic_eval.json", "atomic_eval.json", "chat_eval.json", "qualitative_samples.json")
#: Fields that number a row and are no metrics.
STEP_FIELDS = ("step", "global_step")


def maybe_json(c: Column) -> Column:
    """VARIANT of a text that begins like a list or an object and is one; null for any other, which stays the text it is."""
    t = F.trim(c)
    return F.when(t.startswith("[") | t.startswith("{"), F.try_parse_json(t))


def flatten_json(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, name, value): the scalars of a JSON text under dotted names, as texts; lists are left out, null scalars kept.

    The texts are read once: at every level objects give their members, and the
    scalars found so far pass as they are.
    """
    is_object = F.schema_of_variant("__v").startswith("OBJECT")
    out = df.select(*keys, F.lit("").alias("__at"), F.try_parse_json(value).alias("__v")).filter("__v IS NOT NULL").filter(is_object)
    for _ in range(DEPTH):
        members = out.withColumn("__o", F.when(is_object, F.col("__v")))
        members = members.lateralJoin(members.sparkSession.tvf.variant_explode_outer(F.col("__o").outer()))
        found = F.col("key").isNotNull()
        name = F.when(F.col("__at") == "", F.col("key")).otherwise(F.concat("__at", F.lit("."), "key"))
        members = members.filter(found | F.col("__o").isNull()).select(*keys, F.when(found, name).otherwise(F.col("__at")).alias("__at"), F.when(found, F.col("value")).otherwise(F.col("__v")).alias("__v"))
        out = members.filter(~F.schema_of_variant("__v").startswith("ARRAY"))
    return out.filter(~is_object).select(*keys, F.col("__at").alias("name"), F.col("__v").cast("string").alias("value"))


def _run_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]+$", ""), r"/(?:train|packed)$", "")


def parameters(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, params): the flattened manifests and summaries of every run below root, with its model's name."""
    whole = spark.read.options(recursiveFileLookup="true", pathGlobFilter="{manifest,summary}.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    prefix = F.when(F.col("path").endswith("/summary.json"), "summary").when(F.col("path").rlike("/train/manifest.json$"), "train").when(F.col("path").rlike("/packed/manifest.json$"), "packed").otherwise("manifest")
    flat = flatten_json(whole.select(_run_of(F.col("path")).alias("run_dir"), prefix.alias("prefix"), "value"), ["run_dir", "prefix"], "value")
    params = flat.groupBy("run_dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("prefix", F.lit("."), "name").alias("key"), F.coalesce("value", F.lit("")).alias("value"))))).alias("params"))
    return params.withColumn("model", infer_model_name(F.col("run_dir"), F.col("params"))).withColumn("run_id", stable_run_id(F.col("run_dir"), "backfill"))


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, step, metric, value): numbers and flags of every step log, and of evaluations under "eval.", lost lines left out.

    A row without a step counts by its place in the log, from 0.
    """
    lines = files.numbered_lines(spark, root).filter(F.col("path").endswith("/train_log.jsonl")).withColumn("__v", F.try_parse_json("value"))
    lines = lines.filter(F.schema_of_variant("__v").startswith("OBJECT"))
    step = F.coalesce(F.try_variant_get("__v", "$.global_step", "bigint"), F.try_variant_get("__v", "$.step", "bigint"), F.col("line") - 1)
    log = _numbers(lines.select(_run_of(F.col("path")).alias("run_dir"), step.alias("step"), "__v"), "")
    whole = spark.read.options(recursiveFileLookup="true", pathGlobFilter="{" + ",".join(EVALUATIONS) + "}").text(root, wholetext=True)
    whole = whole.select(_run_of(F.col("_metadata.file_path")).alias("run_dir"), F.lit(None).cast("bigint").alias("step"), F.try_parse_json("value").alias("__v")).filter(F.schema_of_variant("__v").startswith("OBJECT"))
    return log.unionByName(_numbers(whole, "eval."))


def _numbers(df: DataFrame, prefix: str) -> DataFrame:
    parts = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer())).filter(~F.col("key").isin(*STEP_FIELDS))
    kind = F.schema_of_variant("value")
    number = F.when(kind == "BOOLEAN", F.try_variant_get("value", "$", "boolean").cast("double")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get("value", "$", "double"))
    return parts.select("run_dir", "step", F.concat(F.lit(prefix), "key").alias("metric"), number.alias("value")).filter("value IS NOT NULL")
