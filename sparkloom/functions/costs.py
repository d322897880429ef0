"""Closed-form cost of a token, from a model's measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flops_per_token(kind: Column, d: Column, ff: Column, layers: Column, seq: Column, vocab: Column, entries: Column, block: Column, islands: Column, ahead: Column) -> Column:
    """Operations per token: body by model kind, plus the output head and ``ahead`` times the head for further horizons.

    A compressing model runs its attention islands on entries / block of the
    positions and pays for pooling; the other layers are mixers.
    """
    attention, scores, feed, mixer, head = 8 * d * d, 4 * seq * d, 6 * d * ff, 8 * d * d + 10 * d, 2 * d * vocab
    ratio = entries / F.greatest(block, F.lit(1))
    islands_cost = F.floor(islands * ratio * (attention + scores * ratio + feed))
    pooled = F.floor(4 * d * d / F.greatest(block, F.lit(1)) + entries * d)
    compressed = F.greatest(layers - islands, F.lit(0)) * (mixer + feed) + islands_cost + pooled
    body = F.when(kind == "transformer", layers * (attention + scores + feed)).when(kind == "mixer", layers * (mixer + feed)).otherwise(compressed)
    return (body + head + F.floor(ahead * head)).cast("bigint")
