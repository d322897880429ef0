"""Expressions over ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def rms_norm(v: Column, eps: float) -> Column:
    scale = F.sqrt(dot(v, v) / F.size(v) + eps)
    return F.transform(v, lambda x: x / scale)


def rotate(v: Column, position: Column, base: float) -> Column:
    """Rotary transform: the halves of v are turned pairwise by position * base ** (-i / half)."""
    half = (F.size(v) / 2).cast("int")
    angle = lambda i: position * F.pow(F.lit(base), -(i % half) / half)
    partner = lambda i: F.when(i < half, -F.element_at(v, i + half + 1)).otherwise(F.element_at(v, i - half + 1))
    return F.transform(v, lambda x, i: x * F.cos(angle(i)) + partner(i) * F.sin(angle(i)))


def argmax(v: Column) -> Column:
    """First position of the largest value, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")
