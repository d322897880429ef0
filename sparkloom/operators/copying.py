"""Copy routes of a model as array algebra: how much position t draws from an earlier position s of its own sequence.

Each route takes ARRAY ids of one model window and gives a row of weights for
every t. A window is bounded by the model's length, so its square stays inside
one row and no pair of positions is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grid(ids: Column, weight: Callable[[Column, Column], Column]) -> Column:
    places = F.sequence(F.lit(0), F.size(ids) - 1)
    return F.transform(places, lambda t: F.transform(places, lambda s: weight(t, s)))


def _same(ids: Column, a: Column, b: Column) -> Column:
    """1.0 where the ids at both places are there and equal."""
    return F.when(F.get(ids, a) == F.get(ids, b), 1.0).otherwise(0.0)


def normalized(rows: Column) -> Column:
    """Rows scaled to sum 1; rows without weight stay 0."""
    def one(row: Column) -> Column:
        total = F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
        return F.transform(row, lambda x: F.when(total > 0, x / total).otherwise(0.0))

    return F.transform(rows, one)


def _count_upto(ids: Column, t: Column, token: Column) -> Column:
    return F.size(F.filter(F.slice(ids, F.lit(1), t + 1), lambda x: x == token))


def _earlier(t: Column, s: Column, gap: int) -> Column:
    return (s < t) & (t - s >= gap)


def consistency(ids: Column, recent: int, reach: int, strength: float) -> Column:
    """Bias to sources whose neighbourhood of ``reach`` before them holds the ``recent`` last tokens, later ones weighing more."""
    scale = strength / max(1.0, sum(recent - o for o in range(recent)) * (reach + 1.0))

    def weight(t: Column, s: Column) -> Column:
        total = F.lit(0.0)
        for o in range(recent):
            for w in range(reach + 1):
                total = total + (recent - o) * _same(ids, s - w, t - o)
        return F.when(s < t, total * scale).otherwise(0.0)

    return _grid(ids, weight)


def binding_carry(ids: Column, recent: int, reach: int, *, gap: int = 0, most: int = 0) -> Column:
    """Weights of sources up to ``reach`` behind an earlier copy of a recent token, if that token is rare so far (``most`` > 0)."""

    def weight(t: Column, s: Column) -> Column:
        total = F.lit(0.0)
        for o in range(1, recent + 1):
            hits = F.lit(0.0)
            for d in range(1, reach + 1):
                hits = hits + _same(ids, s - d, t - o)
            if most:
                seen = _count_upto(ids, t, F.get(ids, t - o))
                hits = F.when(seen <= most, hits).otherwise(0.0)
            total = total + (recent - o + 1) * hits
        return F.when(_earlier(t, s, gap), total).otherwise(0.0)

    return normalized(_grid(ids, weight))


def last_place(ids: Column, token: int) -> Column:
    """Per position the latest place of token up to it, -1 before the first."""
    places = F.sequence(F.lit(0), F.size(ids) - 1)
    return F.transform(places, lambda t: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), t), lambda i: F.get(ids, i) == token)), F.lit(-1)))


def key_follow(
    ids: Column, recent: int, *, offset: int = 1, span: int = 1, gap: int = 0, until: int | None = None, separator: int | None = None, stops: tuple[int, ...] = (), aligned: bool = False,
    after: int | None = None, match_previous: bool = False,
) -> tuple[Column, Column]:
    """(first, continuation) weights of sources that stand behind an earlier copy of a recent key.

    The key is the token o places back; a source follows its copy by offset …
    offset + span - 1 places, or with aligned by exactly offset + o - 1.
    ``until`` keeps sources before the last such token, ``after`` keys behind
    it; ``separator`` must follow the key; stop tokens are no sources;
    match_previous asks continuations for equal tokens before both places.
    """
    border = last_place(ids, until) if until is not None else None
    start = last_place(ids, after) if after is not None else None

    def weight(offsets_back: range) -> Callable[[Column, Column], Column]:
        def of(t: Column, s: Column) -> Column:
            total = F.lit(0.0)
            for o in offsets_back:
                hits = F.lit(0.0)
                for d in [offset + o - 1] if aligned else range(offset, offset + span):
                    hit = _same(ids, s - d, t - o)
                    if match_previous and aligned and o > 1:
                        hit = hit * _same(ids, s - 1, t)
                    hits = hits + hit
                ok = F.lit(True)
                if separator is not None:
                    ok = ok & F.coalesce(F.get(ids, t - o + 1) == separator, F.lit(False))
                if start is not None:
                    ok = ok & (t - o > F.get(start, t))
                total = total + F.when(ok, (recent - o + 1) * hits).otherwise(0.0)
            ok = _earlier(t, s, gap)
            if stops:
                ok = ok & ~F.get(ids, s).isin(*stops)
            if border is not None:
                ok = ok & (s < F.get(border, t))
            return F.when(ok, total).otherwise(0.0)

        return of

    return normalized(_grid(ids, weight(range(1, 2)))), normalized(_grid(ids, weight(range(2, recent + 1))))


def by_token(df: DataFrame, seq: str, ids: str, weights: str) -> DataFrame:
    """(seq, t, token, p): each position's weights added up by the token they fall on."""
    # outer: of a plain explode the optimizer infers that the weights are not empty, and works them out anew in the scan
    rows = df.select(seq, ids, F.posexplode_outer(weights).alias("t", "row"))
    pairs = rows.select(seq, "t", F.explode_outer(F.filter(F.arrays_zip(F.col(ids).alias("token"), F.col("row").alias("p")), lambda x: x["p"] > 0)).alias("x"))
    return pairs.filter("x IS NOT NULL").groupBy(seq, "t", F.col("x.token").alias("token")).agg(F.sum("x.p").alias("p"))


def log_mix(a: Column, b: Column, share: Column) -> Column:
    """log((1 - share) e^a + share e^b) without overflow."""
    x, y = a + F.log(1 - share), b + F.log(share)
    top = F.greatest(x, y)
    return top + F.log(F.exp(x - top) + F.exp(y - top))


def sample_token(logits: Column, *, temperature: float, top: int | None, seed: int, key: Column) -> Column:
    """Greedy at temperature 0, else the Gumbel-max of the ``top`` best logits, with noise hashed from seed, key and place."""
    if temperature <= 0:
        return (F.array_position(logits, F.array_max(logits)) - 1).cast("bigint")
    floor = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(top), F.size(logits))) if top else F.lit(float("-inf"))

    def noisy(x: Column, i: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        return F.when(x >= floor, x / temperature - F.log(-F.log(u))).otherwise(F.lit(float("-inf")))

    scores = F.transform(logits, noisy)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")
