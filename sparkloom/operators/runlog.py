"""Step logs, sweeps and the run registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_log(log: DataFrame, run: str = "run_id", step: str = "global_step") -> DataFrame:
    """One row per run and step: the latest arrival, exact copies first made one. NaN becomes null."""
    doubles = [f.name for f in log.schema if f.dataType.simpleString() == "double"]
    out = log.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in doubles}).filter(F.col(run).isNotNull() & F.col(step).isNotNull())
    rest = [c for c in out.columns if c not in (run, step)]
    order = ["arrived_at", *[c for c in rest if c != "arrived_at"]] if "arrived_at" in rest else rest
    last = out.groupBy(run, step).agg(F.max(F.struct(*order)).alias("r"))
    return last.select(run, step, *[F.col(f"r.{c}").alias(c) for c in rest])


def summarize_runs(log: DataFrame, loss: str, validation: str, run: str = "run_id", step: str = "global_step") -> DataFrame:
    """Per run: steps, first and last step and loss, first and last validation loss, its change, and its earliest minimum.

    Struct minima and maxima carry the order, so ties go to the earliest step
    and each run is one pass of partial aggregation.
    """
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(step).alias("s"), F.col(c).alias("v")))
    best = F.when(F.col(validation).isNotNull(), F.struct(F.col(validation).alias("v"), F.col(step).alias("s")))
    out = log.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"), F.min(step).alias("first_step"), F.max(step).alias("last_step"),
        F.min(at(loss)).alias("f"), F.max(at(loss)).alias("l"), F.min(at(validation)).alias("vf"), F.max(at(validation)).alias("vl"), F.min(best).alias("b"),
    )
    return out.select(
        run, "n_steps", "first_step", "last_step", F.col("f.v").alias("first_loss"), F.col("l.v").alias("last_loss"), F.col("vf.v").alias("first_val"), F.col("vl.v").alias("last_val"),
        (F.col("vl.v") - F.col("vf.v")).alias("val_delta"), F.col("b.v").alias("best_val"), F.col("b.s").alias("best_step"),
    )


#: Steps of a chunk of a run: what a window orders at a time, however long the run is.
CHUNK_STEPS = 10_000


def _chunked(log: DataFrame, step: str) -> DataFrame:
    return log.withColumn("__chunk", F.floor(F.col(step) / CHUNK_STEPS))


def _before_chunks(log: DataFrame, run: str, **sums) -> DataFrame:
    """Per run and chunk each aggregate over all chunks before it: name=(aggregate, running); a row per chunk."""
    per = log.groupBy(run, "__chunk").agg(*[a.alias(n) for n, (a, _) in sums.items()])
    w = Window.partitionBy(run).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(run, "__chunk", *[running(n).over(w).alias(n) for n, (_, running) in sums.items()])


def progress(log: DataFrame, value: str, run: str = "run_id", step: str = "global_step") -> DataFrame:
    """Validation rows with the running best, whether they improve it strictly, and the streak of rows since they last did.

    A run is ordered chunk by chunk of CHUNK_STEPS; a chunk takes the best and
    the number of rows of those before it from a row per chunk.
    """
    v = _chunked(log.filter(F.col(value).isNotNull()).select(run, step, F.col(value).alias("value")), step)
    w = Window.partitionBy(run, "__chunk").orderBy(step)
    earlier = _before_chunks(v, run, __best=(F.min("value"), F.min), __rows=(F.count(F.lit(1)), F.sum))
    v = v.join(earlier, [run, "__chunk"])
    v = v.withColumn("before", F.least(F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__best"))
    v = v.withColumn("improved", F.col("before").isNull() | (F.col("value") < F.col("before")))
    v = v.withColumn("__at", F.coalesce("__rows", F.lit(0)) + F.row_number().over(w))
    hit = F.when(F.col("improved"), F.col("__at"))
    last = _before_chunks(v.select(run, "__chunk", hit.alias("h")), run, __hit=(F.max("h"), F.max))
    v = v.join(last, [run, "__chunk"]).withColumn("__last", F.coalesce(F.max(hit).over(w), "__hit"))
    return v.select(run, step, "value", F.least("value", "before").alias("best"), "improved", (F.col("__at") - F.col("__last")).cast("bigint").alias("streak"))


def early_stop(log: DataFrame, value: str, *, min_delta: float, patience: int, factor: float = 0.5, run: str = "run_id", step: str = "global_step") -> DataFrame:
    """Fold of each run's validation rows: best, streak, learning-rate scale and the step to stop at (null: never).

    The baseline ratchets on improvements below min_delta, which no window can
    express, so the ordered rows of a run are folded; a run's validation rows
    are few beside its steps.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).alias("v"))))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("streak"), F.lit(1.0).alias("scale"), F.lit(None).cast("bigint").alias("stop"))

    def merge(a: Column, r: Column) -> Column:
        good = r["v"] < a["best"] - min_delta
        streak = F.when(good, 0).otherwise(a["streak"] + 1)
        fired = (streak >= patience) & a["stop"].isNull()
        return F.when(a["stop"].isNotNull(), a).otherwise(
            F.struct(F.least(a["best"], r["v"]).alias("best"), streak.alias("streak"), F.when(fired, a["scale"] * factor).otherwise(a["scale"]).alias("scale"), F.when(fired, r["s"]).alias("stop"))
        )

    folded = log.filter(F.col(value).isNotNull()).groupBy(run).agg(rows.alias("rows")).withColumn("r", F.aggregate("rows", start, merge))
    return folded.select(run, "r.best", F.col("r.streak").cast("bigint").alias("streak"), "r.scale", "r.stop")


def carry_forward(log: DataFrame, value: str, name: str, run: str = "run_id", step: str = "global_step") -> DataFrame:
    """log with the last value known at each step; a run is ordered chunk by chunk, and a chunk begins with the last value before it."""
    c = _chunked(log, step)
    known = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(step).alias("s"), F.col(value).alias("v"))))
    earlier = _before_chunks(c, run, __known=(known, F.max))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(run, "__chunk").orderBy(step))
    return c.join(earlier, [run, "__chunk"]).withColumn(name, F.coalesce(own, F.col("__known.v"))).drop("__chunk", "__known")


#: Ranges a group's values are cut into by approximate quantiles before the exact rank is looked for in one of them.
RANK_RANGES = 64


def nearest_ranks(df: DataFrame, group: str, value: str, share: float, name: str) -> DataFrame:
    """(group, name): the value at the half-even rounded index share * (n - 1) of each group's sorted values, without interpolation.

    Approximate quantiles cut a group into ranges. The ranges are counted, and
    only the one that holds the rank is sorted, so no group is ever collected
    or ordered as a whole; a range of one value needs no sorting. Nulls are left out.
    """
    t = df.filter(F.col(value).isNotNull()).select(group, F.col(value).alias("__x"))
    cuts = [i / RANK_RANGES for i in range(1, RANK_RANGES)]
    bounds = t.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__x", cuts, 10_000).alias("__cuts"))
    # two compared with each cut: values equal to a cut make a range of their own
    at = F.aggregate("__cuts", F.lit(0), lambda a, c: a + F.when(F.col("__x") > c, 2).when(F.col("__x") == c, 1).otherwise(0))
    ranged = t.join(bounds, group).select(group, "__x", "__n", at.alias("__range"))
    sizes = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.max("__n").alias("__n"))
    w = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.bround(F.lit(share) * (F.col("__n") - 1)).cast("bigint")
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0))).withColumn("__rank", rank - F.col("__before"))
    held = sizes.filter("__rank >= 0 AND __rank < __c")
    flat = held.filter("__low = __high").select(group, F.col("__low").alias(name))
    inside = ranged.select(group, "__range", "__x").join(held.filter("__low < __high").select(group, "__range", "__rank"), [group, "__range"])
    inside = inside.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy("__x")) - 1).filter("__rn = __rank")
    return flat.unionByName(inside.select(group, F.col("__x").alias(name)))


def group_stats(df: DataFrame, group: str, value: str, flag: str) -> DataFrame:
    """count, mean, population deviation (0.0 for a single value), all and any of flag; nulls are left out."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.every(flag).alias("all_true"), F.some(flag).alias("any_true")
    )


def first_below(df: DataFrame, group: str, order: str, value: Column, limit: float) -> DataFrame:
    """Per group the first row in order whose value is below limit; null columns where none is."""
    bad = F.min(F.when(value < limit, F.struct(F.col(order).alias("at"), value.alias("value"))))
    return df.groupBy(group).agg(bad.alias("b")).select(group, F.col("b.at").alias("first_at"), F.col("b.value").alias("first_value"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last state of each key; of equal times the greatest status counts. Maps can't be compared, so they ride along by max_by on the rest."""
    rest = [f.name for f in df.schema if f.dataType.typeName() != "map" and f.name != key]
    maps = [f.name for f in df.schema if f.dataType.typeName() == "map"]
    rank = F.struct(order, *[c for c in rest if c != order])
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(rank).alias("r"), *[F.max_by(m, rank).alias(m) for m in maps])
    return out.select(key, *[F.col(f"r.{c}").alias(c) for c in rest], *maps)


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(ids, metric, value) of the numeric columns, null values left out; booleans count 0 and 1."""
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(ids, values, "metric", "value").filter("value IS NOT NULL")


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, not below 0; null where either is missing."""
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return F.when(seconds < 0, 0.0).otherwise(seconds)


def merge_params(old: Column, new: Column) -> Column:
    """Map of both; the new value of a key wins."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>")))


def stable_run_id(source: Column, prefix: str) -> Column:
    """prefix, slug of the last path part and a digest of the whole path."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(source, "/"), -1)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.concat(F.lit(f"{prefix}-"), slug, F.lit("-"), F.substring(F.sha1(source.cast("binary")), 1, 12))


#: What a run's folder may hold in its name, and the kind of model it then is, in order.
MODEL_WORDS = (("transformer", "transformer"), ("mamba", "pure_mamba_like"), ("raam", "raam"))


def infer_model_name(path: Column, params: Column) -> Column:
    """A stated name, else the kind of model that the last part of the path names, else unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    stated = F.coalesce(*[F.nullif(F.try_element_at(params, F.lit(k)), F.lit("")) for k in ("model_name", "manifest.model_name")])
    guess = F.lit("unknown")
    for word, kind in reversed(MODEL_WORDS):
        guess = F.when(F.contains(name, F.lit(word)), kind).otherwise(guess)
    return F.coalesce(stated, guess)


def timeline(df: DataFrame, order: str, name: str) -> DataFrame:
    """One row over checkpoints with target_passed, target_cases, anchor_passed and anchor_cases: how many there are, the first at which
    all targets pass, the first at which the anchors pass as well, and the most passes of either."""
    all_of = lambda kind: (F.coalesce(F.col(f"{kind}_cases"), F.lit(0)) > 0) & (F.col(f"{kind}_passed") == F.col(f"{kind}_cases"))
    first = lambda ok: F.min(F.when(ok, F.struct(order, name)))[name]
    return df.agg(
        F.count(F.lit(1)).alias("checkpoints"), first(all_of("target")).alias("first_targets"), first(all_of("target") & all_of("anchor")).alias("first_all"),
        F.coalesce(F.max("target_passed"), F.lit(0)).alias("best_target"), F.coalesce(F.max("anchor_passed"), F.lit(0)).alias("best_anchor"),
    )


def last_scale(log: DataFrame, order: str, scale: str, new_scale: str, run: str = "run_id") -> DataFrame:
    """(run, scale): the learning-rate scale a resumed run starts with: the last one logged, a new scale before the row's own; 1.0 without any."""
    last = F.max(F.when(F.col(scale).isNotNull() | F.col(new_scale).isNotNull(), F.struct(order, F.coalesce(new_scale, scale).alias("v"))))
    return log.groupBy(run).agg(F.coalesce(last["v"], F.lit(1.0)).alias("scale"))


def total_loss(next_loss: Column, recon: Column, recon_weight: Column, horizons: list[tuple[Column, Column]]) -> Column:
    """Next-token loss plus the weighted reconstruction and horizon losses; a part without a loss or with weight 0 adds nothing."""
    out = next_loss
    for loss, weight in [(recon, recon_weight), *horizons]:
        out = out + F.when(weight != 0, F.coalesce(loss * weight, F.lit(0.0))).otherwise(0.0)
    return out
