"""Rounding, quantiles and falsy defaults with the semantics the models were specified in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go to plus infinity: -2.5 gives -2."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def or_else(x: Column, default: float) -> Column:
    """x, or default where x is null, zero or NaN."""
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(default)).otherwise(x)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def nearest_rank(ordered: Column, p: float) -> Column:
    """Element round(p * (n - 1)) of a sorted array."""
    return F.get(ordered, F.floor((F.size(ordered) - 1) * p + 0.5).cast("int"))


def floor_rank(ordered: Column, p: float) -> Column:
    """Element floor(p * n) of a sorted array, the last at most."""
    return F.get(ordered, F.least(F.floor(F.size(ordered) * p), F.size(ordered) - 1).cast("int"))


def weighted_low(values: Column, weights: Column, p: float) -> Column:
    """The first value, in order, whose weight and that before it reach p of the whole."""
    pairs = F.array_sort(F.arrays_zip(values.alias("v"), weights.alias("w")))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    zero = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("found"))
    step = lambda a, x: F.struct((a["seen"] + x["w"]).alias("seen"), F.coalesce(a["found"], F.when(a["seen"] + x["w"] >= total * p, x["v"])).alias("found"))
    return F.aggregate(pairs, zero, step, lambda a: a["found"])
