"""Vector and grid expressions over arrays; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsmath import clamp


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2_normal(x: Column) -> Column:
    """x over its length; a zero vector stays."""
    return F.transform(x, lambda v: F.when(norm(x) > 0, v / norm(x)).otherwise(v))


def deviation(x: Column, mean: Column) -> Column:
    """x - mean, element by element; a missing mean counts as 0."""
    return F.zip_with(x, mean, lambda v, m: v - F.coalesce(m, F.lit(0.0)))


def masked(x: Column, mask: list[bool]) -> Column:
    allowed = F.array(*map(F.lit, mask))
    return F.transform(x, lambda v, i: F.when(F.get(allowed, i), v).otherwise(0.0))


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    """A 1 at the value's place; an unknown value is all zeros."""
    return F.array(*[F.when(value == v, 1.0).otherwise(0.0) for v in vocabulary])


def heat(x: Column, levels: int | None = None) -> Column:
    """sqrt(v / max), or that in so many levels from 0 on."""
    top = F.array_max(x)
    raw = lambda v: F.sqrt(F.when(top > 0, F.greatest(v, F.lit(0.0)) / top).otherwise(0.0))
    return F.transform(x, lambda v: raw(v) if levels is None else clamp(F.floor(raw(v) * (levels - 1) + 0.5), 0, levels - 1))


def running_max(x: Column) -> Column:
    zero = F.array().cast("array<double>")
    return F.aggregate(x, zero, lambda a, v: F.array_append(a, F.greatest(v, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), v))))


def sampled_curve(points: Column, knots: list[float]) -> Column:
    """A curve of (x, y) structs at fixed knots: linear between points, flat beyond the ends, the identity where
    it has fewer than two points."""
    ordered = F.array_sort(points)
    at = lambda k: F.transform(F.array(ordered), lambda p: _interpolated(p, F.lit(float(k))))[0]
    return F.when(F.size(points) < 2, F.array(*[F.lit(float(k)) for k in knots])).otherwise(F.array(*[at(k) for k in knots]))


def _interpolated(points: Column, k: Column) -> Column:
    below = F.array_max(F.filter(points, lambda p: p["x"] <= k))
    above = F.array_min(F.filter(points, lambda p: p["x"] >= k))
    span = above["x"] - below["x"]
    inside = F.when(span == 0, below["y"]).otherwise(below["y"] + (above["y"] - below["y"]) * (k - below["x"]) / span)
    return F.when(below.isNull(), above["y"]).when(above.isNull(), below["y"]).otherwise(inside)


def top_mean(x: Column, share: float) -> Column:
    """The mean of the largest share of the elements, one at least."""
    k = F.greatest(F.lit(1), F.floor(F.size(x) * share + 0.5)).cast("int")
    return total(F.slice(F.sort_array(x, False), F.lit(1), k)) / k


def oriented(grid: Column, cols: int, rows: int, code: int) -> Column:
    """A row-major grid as its orientation code (1 to 8) shows it upright."""
    wide, high = (cols, rows) if code <= 4 else (rows, cols)
    source = {
        1: lambda c, r: (c, r), 2: lambda c, r: (cols - 1 - c, r), 3: lambda c, r: (cols - 1 - c, rows - 1 - r), 4: lambda c, r: (c, rows - 1 - r),
        5: lambda c, r: (r, c), 6: lambda c, r: (r, rows - 1 - c), 7: lambda c, r: (cols - 1 - r, rows - 1 - c), 8: lambda c, r: (cols - 1 - r, c),
    }[code]
    places = [source(i % wide, i // wide) for i in range(wide * high)]
    return F.array(*[F.get(grid, y * cols + x) for x, y in places])
