"""Deterministic record generators: specs times templates, indexed pairs, key and value maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import order_hash

#: Formats of a generated value.
FORMATS = ("identifier", "filename", "flag", "caseid")


def expand(specs: DataFrame, templates: list[str], names: list[str], limit: int | None = None) -> DataFrame:
    """Each spec with each of the first ``limit`` templates; {column} in a template is replaced. Templates are a fixed list."""
    chosen = templates[:limit] if limit else templates
    prompt = F.element_at(F.array(*map(F.lit, chosen)), F.col("template") + 1)
    for n in names:
        prompt = F.replace(prompt, F.lit("{" + n + "}"), F.col(n).cast("string"))
    return specs.withColumn("template", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1)))).withColumn("prompt", prompt)


def value_for(index: Column, key: Column, form: Column) -> Column:
    stem = F.format_string("copy_%s_%03d", key, index)
    return (
        F.when(form == "identifier", stem).when(form == "filename", F.concat(stem, F.lit(".py"))).when(form == "flag", F.format_string("flag%d_%s_%03d", index % 4, key, index)).otherwise(F.format_string("case_%s_%03d", key, index))
    )


def key_values(spark: SparkSession, rows: int, keys: list[str], variants: int, seed: int) -> DataFrame:
    """(index, variant, seed, slots, tier): maps of generated values, formats rotating with index and key."""
    forms = F.array(*map(F.lit, FORMATS))
    pairs = [F.struct(F.lit(k).alias("k"), value_for(F.col("index"), F.lit(k), F.element_at(forms, ((F.col("index") + i) % len(FORMATS) + 1).cast("int"))).alias("v")) for i, k in enumerate(keys)]
    t = spark.range(rows).select(F.col("id").alias("index"), F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    tier = F.when(F.col("index") < rows // 2, "seen").when(F.col("index") < rows * 3 // 4, "covered").otherwise("heldout")
    return t.withColumns({"seed": seed + 17 * F.col("index") + 1009 * F.col("variant"), "slots": F.map_from_entries(F.array(*pairs)), "tier": tier})


def choose_fields(df: DataFrame, keys: list[str], targets: int, distractors: int) -> DataFrame:
    """df (with seed) with targets and distractors: fields drawn without replacement, in the order of their hashes."""
    if targets + distractors > len(keys) or targets < 1 or distractors < 0:
        raise ValueError("field counts don't fit the keys")
    ranked = F.array_sort(F.array(*[F.struct(order_hash("f", F.concat(F.col("seed").cast("string"), F.lit(k))).alias("h"), F.lit(k).alias("k")) for k in keys]))
    drawn = F.transform(ranked, lambda x: x["k"])
    return df.withColumn("targets", F.slice(drawn, 1, targets)).withColumn("distractors", F.slice(drawn, targets + 1, distractors))


def modes(df: DataFrame, n: int, mode: str) -> DataFrame:
    """Evaluation rows of an indexed generator: mirror repeats the n trained indices, heldout lies behind them, ladder has both."""
    mirror = df.withColumn("index", F.col("index") % n)
    held = df.withColumn("index", F.col("index") + n)
    return {"mirror": mirror, "heldout": held}.get(mode) if mode != "ladder" else mirror.unionByName(held)


def shuffled_context(decoys: DataFrame, key: str, entry: Column, seed: int) -> DataFrame:
    """(key, context): the entries of a key in hash order, one a line; a key has a fixed number of entries."""
    one = decoys.select(key, F.struct(order_hash(seed, entry).alias("h"), entry.alias("e")).alias("x"))
    return one.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "\n").alias("context"))
