"""Arrays of numbers as vectors and sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + F.lit(1e-9)))


def velocity(a: Column) -> Column:
    """First differences; the first is 0, so the length stays."""
    return F.transform(a, lambda x, i: F.when(i > 0, x - F.element_at(a, i)).otherwise(x - x))


def resample(a: Column, length: int) -> Column:
    """Linear resampling to `length` values, ends kept; null for an empty array."""
    n = F.size(a)
    step = (n - 1) / F.lit(max(1, length - 1))

    def at(i: Column) -> Column:
        pos = i * step
        lo = F.floor(pos).cast("int")
        hi = F.least(lo + 1, n - 1)
        x, y = F.get(a, lo), F.get(a, hi)
        return x + (y - x) * (pos - lo)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))


def pad(a: Column, length: Column, fill: float = 0.0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(a)).cast("int")))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 where the union is empty."""
    inter = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def uncovered(a: Column, b: Column, spans: Column) -> Column:
    """Length of [a, b] outside an array of disjoint spans with start and end."""
    inside = F.aggregate(spans, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), F.least(b, x["end"]) - F.greatest(a, x["start"])))
    return (b - a) - inside


def mirror_row(row: Column) -> Column:
    """The landmark row of the other hand: rows 0-20 and 21-41 change places."""
    return F.when(row < 21, row + 21).when(row < 42, row - 21).otherwise(row)
