"""Run tracker on append-only Parquet tables: states, metrics and artifacts; the current registry is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.runlog import duration_seconds

STATES = "run_id string, status string, started_at timestamp, ended_at timestamp, params map<string,string>, at timestamp"
METRICS = "run_id string, step bigint, metric string, value double, at timestamp"
ARTIFACTS = "run_id string, kind string, path string, size bigint, at timestamp"


class Tracker:
    """Tables under one folder. Writers only append, so runs on many hosts never rewrite each other's rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, df: DataFrame) -> None:
        df.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except Exception as e:  # the table has no rows yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _state(self, run_id: str, status: str | None, params: dict | None, started, ended) -> None:
        row = [(run_id, status, started, ended, {k: str(v) for k, v in (params or {}).items()})]
        self._append("states", self.spark.createDataFrame(row, "run_id string, status string, started_at timestamp, ended_at timestamp, params map<string,string>"))

    def start(self, run_id: str, params: dict | None = None, started_at=None) -> None:
        self._state(run_id, "running", params, started_at, None)

    def update_params(self, run_id: str, params: dict) -> None:
        self._state(run_id, None, params, None, None)

    def finish(self, run_id: str, status: str, ended_at=None) -> None:
        self._state(run_id, status, None, None, ended_at)

    def add_states(self, states: DataFrame) -> None:
        """Appends states of many runs at once: (run_id, status, started_at, ended_at, params); ``at``, where given, orders them."""
        at = F.col("at") if "at" in states.columns else F.current_timestamp()
        rows = states.select("run_id", "status", F.col("started_at").cast("timestamp"), F.col("ended_at").cast("timestamp"), F.col("params").cast("map<string,string>"), at.cast("timestamp").alias("at"))
        rows.write.mode("append").parquet(f"{self.root}/states")

    def add_metrics(self, metrics: DataFrame) -> None:
        """Appends (run_id, step, metric, value)."""
        self._append("metrics", metrics.select("run_id", F.col("step").cast("bigint"), "metric", F.col("value").cast("double")))

    def add_artifacts(self, artifacts: DataFrame) -> None:
        """Appends (run_id, kind, path, size); artifacts of unknown size don't exist and are left out."""
        self._append("artifacts", artifacts.filter("size IS NOT NULL").select("run_id", "kind", "path", F.col("size").cast("bigint")))

    def metrics(self) -> DataFrame:
        return self._read("metrics", METRICS)

    def artifacts(self) -> DataFrame:
        return self._read("artifacts", ARTIFACTS)

    def registry(self) -> DataFrame:
        """One row a run: last status, first start, last end, merged params (the later value of a key wins), seconds; latest first."""
        states = self._read("states", STATES)
        params = states.select("run_id", "at", F.explode("params")).groupBy("run_id", "key").agg(F.max(F.struct("at", "value")).alias("v"))
        params = params.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("v.value"))))).alias("params"))
        runs = states.groupBy("run_id").agg(
            F.max(F.when(F.col("status").isNotNull(), F.struct("at", "status"))).alias("s"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at")
        )
        out = runs.join(params, "run_id", "left").withColumn("seconds", duration_seconds(F.col("started_at"), F.col("ended_at")))
        return out.select("run_id", F.col("s.status").alias("status"), "started_at", "ended_at", "seconds", "params").orderBy(F.coalesce("ended_at", "started_at").desc_nulls_last(), "run_id")


def flatten(df: DataFrame, prefix: str = "") -> DataFrame:
    """Nested structs as dotted scalar columns; lists and maps are left out."""

    def walk(schema: T.StructType, path: str) -> list:
        out = []
        for f in schema.fields:
            name = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, name)
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.col(".".join(f"`{p}`" for p in name.split("."))).alias(prefix + name))
        return out

    return df.select(*walk(df.schema, ""))
