"""Session defaults. What the cluster or the caller sets is left as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def get_session(cores: int | str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults that nothing else sets.

    Under spark-submit the submitted master, memory and partitions hold, and a
    default gives way to any submitted value. Without, a local session is made.
    """
    submitted = SparkConf() if "PYSPARK_GATEWAY_PORT" in os.environ else None
    builder = SparkSession.builder.appName("sparkloom")
    if submitted is None or not submitted.contains("spark.master"):
        builder = builder.master(f"local[{cores or '*'}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", shuffle_partitions or 8)
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in DEFAULTS.items():
        if submitted is None or not submitted.contains(key):
            builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of this machine only for a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "sparkloom")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df once, in the shared folder of spark.checkpoint.dir.

    A folder is set here only where the session names none, in local mode; the
    files survive the loss of an executor, and go when the table is no longer
    referred to.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
