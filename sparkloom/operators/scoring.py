"""Scores, classes, confusion counts and pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import missing


def substring_score(df: DataFrame, text: str, required: str, longest: str) -> DataFrame:
    """df with missing (ARRAY), n_present, fits and passed; null flags don't count against a case."""
    gone = missing(F.col(text), F.col(required))
    fits = F.length(text) <= F.col(longest)
    out = df.withColumn("missing", gone).withColumn("n_present", (F.coalesce(F.size(required), F.lit(0)) - F.size("missing")).cast("bigint"))
    return out.withColumn("fits", fits).withColumn("passed", (F.size("missing") == 0) & F.coalesce(F.col("fits"), F.lit(True)))


def cascade(text: Column, rules: list[tuple[str, Column]], default: str = "unknown") -> Column:
    """Label of the first rule that holds."""
    out = None
    for label, rule in rules:
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise(default)


def infer_behavior(c: Column) -> Column:
    """What an answer does, by its form."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return cascade(
        low,
        [
            ("json_tool_command", low.startswith("{") & F.contains(low, F.lit('"cmd"'))),
            ("patch", F.contains(low, F.lit("--- a/")) | F.contains(low, F.lit("```diff"))),
            ("complete_function", F.contains(low, F.lit("def ")) & F.contains(low, F.lit("return"))),
            ("review", F.contains(low, F.lit("guard")) | F.contains(low, F.lit("test"))),
            ("explain", F.contains(low, F.lit("because")) | F.contains(low, F.lit("cause"))),
        ],
    )


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, predicted, n) over rows with an expected label."""
    return df.filter(F.col(expected).isNotNull()).groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(cells: DataFrame) -> DataFrame:
    """One row: labelled, correct, accuracy (null without labels)."""
    hit = F.coalesce(F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n"))), F.lit(0))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("labelled"), hit.alias("correct"), F.try_divide(hit.cast("double"), F.sum("n")).alias("accuracy"))


def pass_rates(df: DataFrame, levels: list[str], passed: str = "passed") -> DataFrame:
    """cases, passes and pass rate per level and for every roll-up of it; null flags are neither cases nor passes."""
    p = F.col(passed)
    return df.rollup(*levels).agg(
        F.count(F.lit(1)).alias("rows"), F.count(p).alias("cases"), F.count_if(p).alias("passes"),
        F.try_divide(F.count_if(p).cast("double"), F.count(p)).alias("pass_rate"), F.grouping_id().cast("bigint").alias("level"),
    )


def sequences_equal(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values in the same order; null where either is null."""
    return F.array_join(a, "\u0001") == F.array_join(b, "\u0001")
