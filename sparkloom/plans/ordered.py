"""Queries q58 to q71: ordered sequences, vectors and synthetic probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.operators import runlog, sequences, tokens
from sparkloom.plans.analysis import r6
from sparkloom.plans.corpus import big
from sparkloom.plans.registry import query
from sparkloom.plans.rules import LOG, TOK
from sparkloom.tables import load, spread

BLOCK, ANCHORS = 8, 2


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _blocks(s, d) -> DataFrame:
    return _vectors(s, d).select("vec_id", F.explode(sequences.blocks(F.col("v"), BLOCK)).alias("b")).select("vec_id", "b.block", F.col("b.part").alias("part"))


_VEC = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"
_PARTS = f"SELECT vec_id, b AS block, v[b * {BLOCK} + 1 : (b + 1) * {BLOCK}] AS part FROM (SELECT *, unnest(range(0, len(v) // {BLOCK})) AS b FROM ({_VEC}))"


def _top(values: str, k: int) -> str:
    """Ascending positions, from 0, of the k largest values."""
    return f"list_sort(list_transform(list_sort(list_transform({values}, lambda x, i: {{'v': -x, 'i': i - 1}}))[1:{k}], lambda s: s.i))"


def _joined(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda i: i + block * {BLOCK}), ',')"


@query("q58", f"SELECT vec_id, block::BIGINT AS block, {_joined(_top('part', ANCHORS))} AS anchors FROM ({_PARTS})")
def q58(s, d):
    """The two best-scored positions of each block."""
    a = sequences.anchors_top(F.col("part"), F.col("block"), BLOCK, ANCHORS)
    return _blocks(s, d).select("vec_id", big("block").alias("block"), F.array_join(a, ",").alias("anchors"))


@query("q59", f"SELECT vec_id, block::BIGINT AS block, {_joined('[0, 2, 5, 7]')} AS anchors FROM ({_PARTS})")
def q59(s, d):
    """Four evenly spaced positions of each block."""
    a = sequences.anchors_uniform(F.size("part"), F.col("block"), BLOCK, 4)
    return _blocks(s, d).select("vec_id", big("block").alias("block"), F.array_join(a, ",").alias("anchors"))


_IDS = "list_transform(part, lambda x: floor(abs(x) * 100000))"
_MASKED = f"list_transform(part, lambda x, i: CASE WHEN list_contains(res, i - 1) THEN -1e300 ELSE x END)"


@query("q60", f"SELECT vec_id, block::BIGINT AS block, {_joined(f'list_sort(list_concat(res, {_top(_MASKED, 2)}))')} AS anchors FROM (SELECT *, {_top(_IDS, 1)} AS res FROM ({_PARTS}))")
def q60(s, d):
    """The highest id of each block, then the two best scores among the rest."""
    ids = F.transform("part", lambda x: F.floor(F.abs(x) * 100000).cast("double"))
    a = sequences.anchors_hybrid(ids, F.col("part"), F.col("block"), BLOCK, 3, 1)
    return _blocks(s, d).select("vec_id", big("block").alias("block"), F.array_join(a, ",").alias("anchors"))


@query("q61", f"""
SELECT vec_id, block::BIGINT AS block, round(list_sum(list_transform(part, lambda x: x * exp(x - list_max(part)))) / list_sum(list_transform(part, lambda x: exp(x - list_max(part)))), 6) AS pooled,
 round(list_sum(part[4:8]), 6) AS last_sum FROM ({_PARTS})""")  # fmt: skip
def q61(s, d):
    """Softmax pooling of each block and its last causal moving sum over five values."""
    moving = sequences.causal_moving_sum(F.col("part"), 5)
    return _blocks(s, d).select("vec_id", big("block").alias("block"), r6(sequences.softmax_pool(F.col("part"))).alias("pooled"), r6(F.element_at(moving, -1)).alias("last_sum"))


@query("q62", """
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id // 64 ORDER BY label, vec_id) - 1)::BIGINT AS new_pos, count(*) OVER (PARTITION BY vec_id // 64 ORDER BY label RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS visible FROM embeddings""")  # fmt: skip
def q62(s, d):
    """Stable order by origin within sequences of 64, with the inverse kept as vec_id, and the visible positions of each."""
    t = load(s, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 64).alias("seq"))
    return sequences.stable_order(t, "seq", "label", "vec_id").select("vec_id", "new_pos", "visible")


@query("q63", f"""
SELECT doc_id, max(segment)::BIGINT AS last_segment, sum(last_boundary)::BIGINT AS boundary_sum FROM (SELECT doc_id, coalesce(max(CASE WHEN contains(token, chr(10)) THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS last_boundary,
 coalesce(sum(CASE WHEN contains(token, chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM ({TOK})) GROUP BY 1""")  # fmt: skip
def q63(s, d):
    """Running boundary and segments between line breaks, per document."""
    # what a token is has been told before the shuffle, so only flags travel
    flags = tokens.tokens(spread(load(s, d, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "pos", F.contains("token", F.lit("\n")).alias("b"))
    t = sequences.boundaries(flags, "doc_id", F.col("b"))
    return t.groupBy("doc_id").agg(big(F.max("segment")).alias("last_segment"), big(F.sum("last_boundary")).alias("boundary_sum"))


def _codes(s, d):
    """(doc_id, pos, token) with a token's 64-bit code for its text; within a document these tell tokens apart and travel lighter."""
    return tokens.tokens(spread(load(s, d, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "pos", F.xxhash64("token").alias("token"))


@query("q64", f"""
SELECT doc_id, sum(m)::BIGINT AS matches, round(sum(CASE WHEN pos > 0 THEN m / pos::DOUBLE ELSE 0 END), 6) AS weight, max(m)::BIGINT AS most FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) - 1 AS m FROM ({TOK})) GROUP BY 1""")  # fmt: skip
def q64(s, d):
    """Causal token matches of each document and the weight they receive."""
    t = sequences.causal_matches(_codes(s, d), "doc_id")
    return t.groupBy("doc_id").agg(F.sum("matches").alias("matches"), r6(F.sum("p")).alias("weight"), F.max("matches").alias("most"))


@query("q65", f"""
WITH n AS (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM ({TOK})),
 f AS (SELECT *, lag(pos) OVER w AS p, lag(next) OVER w AS q, row_number() OVER w - 1 AS o FROM n WINDOW w AS (PARTITION BY doc_id, token ORDER BY pos)),
 g AS (SELECT *, CASE WHEN pos - p >= 2 AND o <= 8 THEN q END AS predicted FROM f)
SELECT doc_id, count(predicted)::BIGINT AS predictions, count(*) FILTER (WHERE predicted = next)::BIGINT AS hits FROM g GROUP BY 1""")  # fmt: skip
def q65(s, d):
    """Key-follow: what came after the last equal token, with a gap and an occurrence limit, against what comes next."""
    t = sequences.key_follow(_codes(s, d), "doc_id", least_gap=2, most_occurrences=8)
    return t.groupBy("doc_id").agg(F.count("predicted").alias("predictions"), F.count_if(F.col("predicted") == F.col("next")).alias("hits"))


@query("q66", f"""
SELECT run_id, round(CASE WHEN sum(m) > 0 THEN sum(l * m) / sum(m) ELSE 0 END, 6)::DOUBLE AS loss, sum(m)::DOUBLE AS weight FROM (SELECT run_id, lead(next_token_loss, 2) OVER w AS l, lead(CASE WHEN grad_norm < 1 THEN 1.0 ELSE 0.0 END::DOUBLE, 2) OVER w AS m
 FROM (SELECT * FROM ({LOG}) WHERE next_token_loss IS NOT NULL AND grad_norm IS NOT NULL) WINDOW w AS (PARTITION BY run_id ORDER BY global_step)) WHERE l IS NOT NULL AND m IS NOT NULL GROUP BY 1""")  # fmt: skip
def q66(s, d):
    """Masked loss two steps ahead."""
    t = runlog.clean_log(load(s, d, "train_log")).filter("next_token_loss IS NOT NULL AND grad_norm IS NOT NULL")
    return sequences.shifted_loss(t, "run_id", "global_step", "next_token_loss", F.col("grad_norm") < 1, 2).withColumn("loss", r6("loss"))


@query("q67", f"""
SELECT seq::BIGINT AS seq, count(*)::BIGINT AS n, count(*) FILTER (WHERE guess = target)::BIGINT AS correct FROM (SELECT vec_id // 64 AS seq, (list_position(v, list_max(v)) - 1) % 10 AS guess, lead(label) OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) AS target FROM ({_VEC}))
 WHERE target IS NOT NULL GROUP BY 1""")  # fmt: skip
def q67(s, d):
    """Greedy prediction of the next label from each vector."""
    from pyspark.sql import Window

    t = _vectors(s, d).withColumn("seq", F.floor(F.col("vec_id") / 64))
    t = t.select("seq", (vectors.argmax(F.col("v")) % 10).alias("guess"), F.lead("label").over(Window.partitionBy("seq").orderBy("vec_id")).alias("target")).filter("target IS NOT NULL")
    return t.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") == F.col("target")).alias("correct"))


@query("q68", f"""
WITH b AS (SELECT vec_id, block, list_sum(part) AS value FROM ({_PARTS})) SELECT vec_id, b.block::BIGINT AS block, round(b.value, 6) AS value, round(coalesce(p.value, 0), 6) AS previous FROM b LEFT JOIN (SELECT vec_id, block + 1 AS block, value FROM b) p USING (vec_id, block)""")  # fmt: skip
def q68(s, d):
    """Each block beside the sum of the block before it."""
    b = _blocks(s, d).select("vec_id", "block", F.aggregate("part", F.lit(0.0), lambda a, x: a + x).alias("value"))
    t = sequences.previous_block(b, "vec_id", "block", "value")
    return t.select("vec_id", big("block").alias("block"), r6("value").alias("value"), r6("previous").alias("previous"))


@query("q69", f"""
WITH e AS (SELECT vec_id // 64 AS seq, vec_id % 64 AS pos, label, v FROM ({_VEC})), s AS (SELECT q.seq, q.pos, k.label, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * k.v[i])) / sqrt(len(q.v)) AS s
 FROM e q JOIN e k ON q.seq = k.seq AND k.pos BETWEEN q.pos - 4 AND q.pos - 1), w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos)) AS x FROM s)
SELECT seq::BIGINT AS seq, pos::BIGINT AS pos, round(sum(x * label) / sum(x), 5) AS out FROM w GROUP BY 1, 2""")  # fmt: skip
def q69(s, d):
    """Attention-weighted mean of the labels of the four positions before."""
    t = _vectors(s, d).select(F.floor(F.col("vec_id") / 64).alias("seq"), (F.col("vec_id") % 64).alias("pos"), "v", F.col("label").cast("double").alias("label"))
    return sequences.attend_back(t, "seq", "pos", "v", "label", 4).withColumn("out", r6("out", 5))


@query("q70", f"""
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v) + 1e-6), 6) AS rms_first,
 round(v[1] * cos(vec_id % 64) - v[len(v) // 2 + 1] * sin(vec_id % 64), 6) AS rotated_first FROM ({_VEC})""")  # fmt: skip
def q70(s, d):
    """Norm, RMS norm and rotary transform of each vector."""
    t = _vectors(s, d)
    v = F.col("v")
    return t.select(
        "vec_id", r6(vectors.norm(v)).alias("norm"), r6(F.element_at(vectors.rms_norm(v, 1e-6), 1)).alias("rms_first"), r6(F.element_at(vectors.rotate(v, F.col("vec_id") % 64, 10000.0), 1)).alias("rotated_first")
    )


@query("q71", """
SELECT 'copy' AS probe, b::BIGINT AS b, t::BIGINT AS t, ((7 * (t % 32) + 13 * b) % 256)::BIGINT AS token FROM range(4) x(b), range(64) y(t)
UNION ALL SELECT 'recall', b, t, (CASE WHEN t < 24 THEN CASE t % 3 WHEN 0 THEN (t // 3 * 7 + 20 + b) % 256 WHEN 1 THEN ((t // 3 * 7 + 20 + b) % 256 * 3 + 5) % 256 ELSE 1 END
 WHEN t = 24 THEN 2 WHEN t = 25 THEN (4 * 7 + 20 + b) % 256 WHEN t = 26 THEN ((4 * 7 + 20 + b) % 256 * 3 + 5) % 256 ELSE (t - 27 + 31 + b) % 256 END)::BIGINT FROM range(4) x(b), range(64) y(t)
UNION ALL SELECT 'passkey', b, t, (CASE WHEN t = 61 THEN 3 WHEN t IN (16, 62) THEN 7 WHEN t IN (17, 63) THEN (100 + b * 13) % 256 ELSE (t * 17 + 9) % 256 END)::BIGINT FROM range(4) x(b), range(64) y(t)
UNION ALL SELECT 'state', b, t, (CASE WHEN t >= 63 THEN (10 + b + 3 * 21) % 256 WHEN t % 3 = 0 THEN 4 WHEN t % 3 = 1 THEN 5 ELSE (10 + b + 3 * (t // 3 + 1)) % 256 END)::BIGINT FROM range(4) x(b), range(64) y(t)""")  # fmt: skip
def q71(s, d):
    """Four synthetic probes of length 64: copied spans, recalled pairs, a hidden pass key, a tracked state."""
    g = s.range(4 * 64).select(F.floor(F.col("id") / 64).alias("b"), (F.col("id") % 64).alias("t"))
    b, t = F.col("b"), F.col("t")
    pair = lambda i: (i * 7 + 20 + b) % 256
    third = F.floor(t / 3)
    copy = (7 * (t % 32) + 13 * b) % 256
    inner = F.when(t % 3 == 0, pair(third)).when(t % 3 == 1, (pair(third) * 3 + 5) % 256).otherwise(1)
    recall = F.when(t < 24, inner).when(t == 24, 2).when(t == 25, pair(F.lit(4))).when(t == 26, (pair(F.lit(4)) * 3 + 5) % 256).otherwise((t + 4 + b) % 256)
    key = F.when(t == 61, 3).when(t.isin(16, 62), 7).when(t.isin(17, 63), (100 + b * 13) % 256).otherwise((t * 17 + 9) % 256)
    state = F.when(t >= 63, (10 + b + 63) % 256).when(t % 3 == 0, 4).when(t % 3 == 1, 5).otherwise((10 + b + 3 * (third + 1)) % 256)
    return g.select("b", "t", F.explode(F.array(*[F.struct(F.lit(n).alias("probe"), big(c).alias("token")) for n, c in (("copy", copy), ("recall", recall), ("passkey", key), ("state", state))])).alias("p")).select("p.probe", "b", "t", "p.token")
