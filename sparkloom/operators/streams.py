"""Splitting documents, laying them out as one token stream, and cutting the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import order_hash
from sparkloom.operators.ranking import global_row_number, global_running_sum


def split_train_val(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """df with rn (rank in hash order) and split: the first max(1, half-even round of n * fraction) rows are val."""
    ranked = global_row_number(df.withColumn("__h", order_hash(seed, F.col(key))), "__h", key)
    count = df.agg(F.count(F.lit(1)).alias("__n"))
    limit = F.greatest(F.lit(1), F.bround(F.col("__n") * fraction).cast("bigint"))
    one = count.withColumn("__k", F.lit(1))
    out = ranked.withColumn("__k", F.lit(1)).join(F.broadcast(one), "__k")  # one row
    return out.withColumn("split", F.when(F.col("rn") <= limit, "val").otherwise("train")).drop("__k", "__n", "__h")


def offsets(df: DataFrame, key: str, length: Column, seed: int) -> DataFrame:
    """df with start and stop of each document in a stream of all, in hash order."""
    out = global_running_sum(df.withColumn("__h", order_hash(seed, F.col(key))), "__h", key, length, "start")
    return out.withColumn("stop", F.col("start") + length).drop("__h")


def windows(spans: DataFrame, size: int) -> DataFrame:
    """(window, n_documents, n_tokens) of fixed windows over the stream of spans (start, stop)."""
    spans = spans.filter("stop > start")
    w = spans.select("start", "stop", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("window"))
    inside = F.least(F.col("stop"), (F.col("window") + 1) * size) - F.greatest(F.col("start"), F.col("window") * size)
    return w.groupBy("window").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(inside).alias("n_tokens"))


def shuffle_chunks(total: DataFrame, size: int, seed: int) -> DataFrame:
    """(chunk, first, length, start): chunks of a stream in hash order with their new offsets. ``total`` is one row (n)."""
    chunks = total.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / size)))).alias("chunk"), "n").filter("n > 0")
    length = F.least(F.lit(size), F.col("n") - F.col("chunk") * size)
    chunks = chunks.select("chunk", (F.col("chunk") * size).alias("first"), length.cast("bigint").alias("length"))
    return global_running_sum(chunks.withColumn("__h", order_hash(seed, F.col("chunk"))), "__h", "chunk", F.col("length"), "start").drop("__h")


def batch_starts(stream_length: int, window: int, seed: int) -> Column:
    """Start of the window of batch row ``id``, uniform over the stream by hash, the same on every engine; 0 where the stream is shorter than a window."""
    if stream_length <= window:
        return F.lit(0).cast("bigint")
    return F.pmod(F.conv(F.substring(order_hash(seed, F.col("id")), 1, 15), 16, 10).cast("bigint"), F.lit(stream_length - window))
