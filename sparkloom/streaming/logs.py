"""Step logs as streams: tailing appended files, live aggregates, and a stateful early stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "run_id string, global_step bigint, train_loss double, val_next_token_loss double, logged_at timestamp"


def tail(spark: SparkSession, folder: str, schema: str = LOG, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """Rows appended to a folder of log files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def live_summary(log: DataFrame, delay: str | None = None) -> DataFrame:
    """Steps and best losses per run and day of logging.

    Without a delay every late row counts, whatever batch it comes in; days are
    kept as state and rewritten in update mode. With one, state of older days
    is dropped and rows later than that are left out, so that state stays
    bounded in a query that never ends.
    """
    log = log.filter("run_id IS NOT NULL AND NOT isnan(train_loss)").withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    if delay:
        log = log.withWatermark("logged_at", delay)
    return log.groupBy(F.window("logged_at", "1 day").alias("day"), "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("global_step").alias("last_step"), F.min("train_loss").alias("best_loss")
    )


def early_stop(log: DataFrame, *, min_delta: float, patience: int, factor: float = 0.5) -> DataFrame:
    """Per run and batch the folded state: best, streak, scale, stop. State is a few numbers a run.

    Rows of a batch are folded in step order; a row whose step is not beyond
    the last one seen (a repeated delivery) is skipped.
    """
    log = log.filter("run_id IS NOT NULL AND val_next_token_loss IS NOT NULL AND NOT isnan(val_next_token_loss)").select("run_id", "global_step", "val_next_token_loss")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, streak, scale, stop, seen = state.get if state.exists else (float("inf"), 0, 1.0, -1, -1)
        rows = pd.concat(list(frames)).sort_values(["global_step", "val_next_token_loss"])
        for step, value in zip(rows["global_step"], rows["val_next_token_loss"]):
            if step <= seen:
                continue
            seen = int(step)
            if stop >= 0:
                continue
            streak = 0 if value < best - min_delta else streak + 1
            best = min(best, float(value))
            if streak >= patience:
                stop, scale = int(step), scale * factor
        state.update((best, streak, scale, stop, seen))
        yield pd.DataFrame([(key[0], best, streak, scale, stop)], columns=["run_id", "best", "streak", "scale", "stop"])

    return log.groupBy("run_id").applyInPandasWithState(
        fold, "run_id string, best double, streak bigint, scale double, stop bigint", "best double, streak bigint, scale double, stop bigint, seen bigint", "update", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, folder: str, mode: str = "append", keep: str | None = None) -> None:
    """Runs a stream over what is there and stops; each batch is written to folder, or with keep only each key's last row."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("append").parquet(folder) if keep is None else df.withColumn("__batch", F.lit(batch)).write.mode("append").parquet(folder)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}_state").trigger(availableNow=True).start()
    q.awaitTermination()
