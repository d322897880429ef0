"""Replicating, balancing and separating records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import order_hash


def replicate(df: DataFrame, times: Column, name: str = "copy") -> DataFrame:
    """Each row as often as times says, at least once, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), times).cast("int") - 1)))


def capped_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows that come first in hash order: a top-n, not a sort of everything."""
    return df.orderBy(order_hash(seed, F.col(key)), key).limit(n)


def decoys(specs: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """(target, decoy, j): for each row count other rows, no two the same.

    Rows stand in a ring in hash order; decoy j of a row is the j-th after it,
    so an equi-join on the rank finds it. ``specs`` is a generator's table of
    fixed size.
    """
    from pyspark.sql import Window

    ring = specs.select(F.col(key).alias("name"), F.row_number().over(Window.orderBy(order_hash(seed, F.col(key)), key)).alias("r"))
    n = ring.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    ring = ring.withColumn("one", F.lit(1)).join(n, "one").drop("one")
    asked = ring.select(F.col("name").alias("target"), F.explode(F.sequence(F.lit(1), F.least(F.lit(count), F.col("n").cast("int") - 1))).alias("j"), "r", "n").filter("n > 1")
    asked = asked.withColumn("at", F.pmod(F.col("r") - 1 + F.col("j"), F.col("n")) + 1)
    return asked.join(ring.select(F.col("name").alias("decoy"), F.col("r").alias("at")), "at").select("target", "decoy", F.col("j").cast("bigint").alias("j"))


def text_key(column: Column) -> Column:
    """SHA-256 of a text, which stands for it in joins and distinct counts; null for null."""
    return F.unhex(F.sha2(column.cast("binary"), 256))


def overlap(train: DataFrame, held_out: DataFrame, column: str) -> DataFrame:
    """Distinct values of column on both sides. Only hashes of the training texts are shuffled; the texts come from the held-out side."""
    keys = train.select(text_key(F.col(column)).alias("__key")).filter("__key IS NOT NULL").distinct()
    held = held_out.select(column, text_key(F.col(column)).alias("__key")).filter("__key IS NOT NULL").dropDuplicates(["__key"])
    return held.join(keys, "__key", "left_semi").select(column)


def disjoint(train: DataFrame, held_out: DataFrame, column: str) -> DataFrame:
    """Rows of train whose value is not held out; a null value is held out by nothing. Joined on hashes."""
    keys = held_out.select(text_key(F.col(column)).alias("__key")).filter("__key IS NOT NULL").distinct()
    return train.withColumn("__key", text_key(F.col(column))).join(keys, "__key", "left_anti").drop("__key")


def behavior_in(behaviors: list[str], column: Column) -> Column:
    return column.isin(*behaviors)


def contains_any(needles: list[str], column: Column) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(column, F.lit(n))
    return out
