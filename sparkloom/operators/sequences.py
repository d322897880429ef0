"""Ordered-sequence algebra: anchors per block, pooling, boundaries, token matching, shifted losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.vectors import dot
from sparkloom.operators.ranking import top_n_per_array


def blocks(v: Column, size: int) -> Column:
    """ARRAY<STRUCT<block, part>> of consecutive parts of size values; the last may be shorter."""
    n = F.ceil(F.size(v) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(b.alias("block"), F.slice(v, b * size + 1, F.lit(size)).alias("part")))


def anchors_top(scores: Column, block: Column, size: int, k: int) -> Column:
    """Ascending positions of the k best scores of a block; a short block repeats its last position."""
    got = F.transform(top_n_per_array(scores, k), lambda i: i + block * size)
    last = block * size + F.size(scores) - 1
    return F.concat(got, F.array_repeat(last, F.greatest(F.lit(0), F.lit(k) - F.size(got))))


def anchors_uniform(length: Column, block: Column, size: int, k: int) -> Column:
    """k evenly spaced positions of a block, half-even rounded and clipped to its length."""
    grid = [F.bround(F.lit(i * (size - 1) / max(1, k - 1))).cast("int") for i in range(k)]
    return F.transform(F.array(*grid), lambda i: F.least(i, length - 1) + block * size)


def anchors_hybrid(ids: Column, scores: Column, block: Column, size: int, k: int, reserve: int) -> Column:
    """The reserve highest ids, then the best scores among the rest, ascending."""
    kept = top_n_per_array(ids, reserve)
    masked = F.transform(scores, lambda x, i: F.when(F.array_contains(kept, i), F.lit(-1e300)).otherwise(x))
    filled = F.slice(top_n_per_array(masked, k - reserve), 1, F.greatest(F.lit(0), F.size(scores) - F.size(kept)))
    return F.transform(F.array_sort(F.array_union(kept, filled)), lambda i: i + block * size)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def softmax_pool(v: Column) -> Column:
    """Mean of v under its own softmax."""
    return dot(softmax(v), v)


def causal_moving_sum(v: Column, width: int) -> Column:
    """Sum of the last width values at each position."""
    return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.greatest(F.lit(1), i - width + 2), F.least(F.lit(width), i + 1)), F.lit(0.0), lambda a, x: a + x))


def stable_order(df: DataFrame, seq: str, origin: str, idx: str) -> DataFrame:
    """df with new_pos (rank by origin, ties in order), and visible: positions whose origin is not above this one's.

    visible is the theta join key.origin <= query.origin counted by a range
    frame, so no pair is formed.
    """
    by = Window.partitionBy(seq).orderBy(origin, idx)
    upto = Window.partitionBy(seq).orderBy(origin).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("new_pos", (F.row_number().over(by) - 1).cast("bigint")).withColumn("visible", F.count(F.lit(1)).over(upto))


def boundaries(tok: DataFrame, key: str, is_boundary: Column) -> DataFrame:
    """tok with last_boundary (position of the latest boundary up to here, -1 before any) and segment (boundaries strictly before)."""
    w = Window.partitionBy(key).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = tok.withColumn("__b", is_boundary)
    return (
        t.withColumn("last_boundary", F.coalesce(F.max(F.when(F.col("__b"), F.col("pos"))).over(w), F.lit(-1)))
        .withColumn("segment", F.coalesce(F.count_if("__b").over(before), F.lit(0)))
        .drop("__b")
    )


def causal_matches(tok: DataFrame, key: str) -> DataFrame:
    """tok with matches: earlier positions of the document with the same token, and p, its share of all earlier positions.

    Scattering each position's uniform weight onto the tokens before it and
    adding up per token is a running count, so the token self-join with its
    quadratic pairs never happens.
    """
    seen = F.row_number().over(Window.partitionBy(key, "token").orderBy("pos")) - 1
    t = tok.withColumn("matches", seen.cast("bigint"))
    return t.withColumn("p", F.when(F.col("pos") > 0, F.col("matches") / F.col("pos")).otherwise(0.0))


def key_follow(tok: DataFrame, key: str, *, least_gap: int, most_occurrences: int) -> DataFrame:
    """tok with predicted: the token after the latest earlier equal token, if far enough back and not too common so far."""
    doc = Window.partitionBy(key).orderBy("pos")
    same = Window.partitionBy(key, "token").orderBy("pos")
    t = tok.withColumn("next", F.lead("token").over(doc))
    t = t.withColumn("__p", F.lag("pos").over(same)).withColumn("__n", F.lag("next").over(same)).withColumn("__o", F.row_number().over(same) - 1)
    ok = (F.col("pos") - F.col("__p") >= least_gap) & (F.col("__o") <= most_occurrences)
    return t.withColumn("predicted", F.when(ok, F.col("__n"))).drop("__p", "__n", "__o")


def request_follow(requests: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Each output segment with the request that it serves: the n-th request of a record goes to its n-th segment.

    requests: key, pos, token; outputs: key, segment, first. Missing requests
    leave a null token.
    """
    asked = requests.withColumn("segment", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    return outputs.join(asked.select(key, "segment", F.col("token").alias("requested")), [key, "segment"], "left")


def shifted_loss(df: DataFrame, seq: str, order: str, loss: str, mask: Column, horizon: int) -> DataFrame:
    """Per sequence the masked mean of the loss ``horizon`` steps ahead; 0.0 where nothing is masked in."""
    w = Window.partitionBy(seq).orderBy(order)
    t = df.withColumn("__l", F.lead(loss, horizon).over(w)).withColumn("__m", F.lead(mask.cast("double"), horizon).over(w))
    t = t.filter(F.col("__l").isNotNull() & F.col("__m").isNotNull())
    total = F.sum("__m")
    return t.groupBy(seq).agg(F.when(total > 0, F.sum(F.col("__l") * F.col("__m")) / total).otherwise(0.0).alias("loss"), total.alias("weight"))


def previous_block(df: DataFrame, seq: str, block: str, value: str) -> DataFrame:
    """df with previous: value of the block before in the sequence, 0 for the first."""
    prev = df.select(F.col(seq), (F.col(block) + 1).alias(block), F.col(value).alias("previous"))
    return df.join(prev, [seq, block], "left").withColumn("previous", F.coalesce("previous", F.lit(0.0)))


def attend_back(df: DataFrame, seq: str, pos: str, vector: str, value: str, reach: int) -> DataFrame:
    """(seq, pos, out): mean of value over the reach positions before, weighted by the softmax of scaled dot products.

    Positions meet by equality of position after each key is offered to the
    reach positions behind it, so the join is linear in the rows.
    """
    offers = df.select(seq, F.explode(F.sequence(F.col(pos) + 1, F.col(pos) + reach)).alias(pos), F.col(vector).alias("k"), F.col(value).alias("v"))
    joined = df.select(seq, pos, F.col(vector).alias("q")).join(offers, [seq, pos])
    s = joined.withColumn("s", dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q")))
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(Window.partitionBy(seq, pos))))
    return e.groupBy(seq, pos).agg((F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("out"))
