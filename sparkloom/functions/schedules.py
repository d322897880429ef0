"""Learning-rate and weight schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_for_step(step: Column, base: float, warmup: int, *, cosine: bool, least: float = 0.0, start: int = 0, end: int = 0) -> Column:
    """Linear warm-up, then constant, then (with cosine) a half cosine from start to end, then least."""
    rate = F.lit(float(base))
    if cosine:
        span = max(1, end - start - 1)
        done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - start) / span))
        falling = F.lit(least) + (base - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * done))
        rate = F.when(step >= start, falling).otherwise(rate)
    if warmup > 0:
        rate = F.when(step < warmup, base * (step + 1) / warmup).otherwise(rate)
    return rate


def ramp(step: Column, first: int, length: int, weight: float) -> Column:
    """0 before first, then linear up to weight within length steps."""
    up = F.least(F.lit(1.0), (step - first + 1) / max(1, length))
    return F.when(step < first, F.lit(0.0)).otherwise(weight * up)
