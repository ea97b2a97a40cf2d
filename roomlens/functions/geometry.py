"""Column expressions over rings: arrays of numbers x1, y1, x2, y2, ... of a polygon that isn't closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(flat: Column, value) -> Column:
    """Sum over the edges of value(x, y, next x, next y)."""
    n = F.size(flat)
    at = lambda i: F.get(flat, i).cast("double")
    steps = F.sequence(F.lit(0), n - 2, F.lit(2))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + value(at(i), at(i + 1), at((i + 2) % n), at((i + 3) % n)))


def ring_area(flat: Column) -> Column:
    return F.abs(_fold(flat, lambda x, y, u, v: x * v - u * y)) / 2


def ring_centroid(flat: Column) -> tuple[Column, Column]:
    cross = _fold(flat, lambda x, y, u, v: x * v - u * y)
    return (
        F.try_divide(_fold(flat, lambda x, y, u, v: (x + u) * (x * v - u * y)), 3 * cross),
        F.try_divide(_fold(flat, lambda x, y, u, v: (y + v) * (x * v - u * y)), 3 * cross),
    )
