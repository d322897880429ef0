"""Global ranks and running sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_bucket(df: DataFrame, hash_column: str, digits: int) -> DataFrame:
    return df.withColumn("__bucket", F.substring(hash_column, 1, digits))


def global_row_number(df: DataFrame, hash_column: str, tie: str, name: str = "rn", digits: int = 3) -> DataFrame:
    """df with the rank by (hash_column, tie), from 1.

    hash_column is a hex digest, so its first digits cut the rows into even
    ranges in rank order: each range ranks its own rows, and starts from the
    count of the ranges before it, of which there are 16 ** digits at most.
    """
    b = _with_bucket(df, hash_column, digits)
    sizes = b.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(hash_column, tie))
    return b.withColumn("__rn", own).join(sizes, "__bucket").withColumn(name, F.col("__rn") + F.col("__before")).drop("__bucket", "__rn", "__before")


def global_running_sum(df: DataFrame, hash_column: str, tie: str, value: Column, name: str, digits: int = 3) -> DataFrame:
    """df with the sum of value over all rows before this one in the order (hash_column, tie)."""
    b = _with_bucket(df, hash_column, digits).withColumn("__v", value)
    sums = b.groupBy("__bucket").agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum("__v").over(Window.partitionBy("__bucket").orderBy(hash_column, tie).rowsBetween(Window.unboundedPreceding, -1))
    out = b.withColumn("__own", F.coalesce(own, F.lit(0))).join(sums, "__bucket")
    return out.withColumn(name, F.col("__own") + F.col("__before")).drop("__bucket", "__v", "__own", "__before")


def first_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group in order; Catalyst turns this into a group limit before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def top_n_per_array(scores: Column, n: int) -> Column:
    """Positions (from 0, ascending) of the n largest values of an array; ties go to the earlier one."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda s: s["i"]))
