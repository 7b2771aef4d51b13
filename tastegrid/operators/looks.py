"""Looks foretold from features: a coupled ridge head for all percentiles, whose answers are kept in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, look
from . import evaluate, folds


def ordered(percentiles: Column) -> Column:
    """Percentiles that a solver can look for: none below the one before, within 0 and 1."""
    return F.transform(arrays.running_max(percentiles), lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def foretold(frames: DataFrame, key: str, session: str, x: str, wanted: str, *, k: int = 5, penalty: float = 0.1) -> DataFrame:
    """frames (key, session, x, wanted look): of every frame, from sessions other than its own, the look foretold in
    order, and how far it and the mean look of those sessions are off, in code values."""
    dealt = folds.dealt(frames.select(F.col(key).alias("_key"), F.col(session).alias("_session"), F.col(x).alias("_x"), F.col(wanted).alias("_y")), "_session", k)
    held = evaluate.held_out_deltas(dealt, "_key", "_x", "_y", penalty)
    told = held.withColumn("foretold", ordered(F.col("predicted")))
    off = lambda c: look.distance(F.col(c), F.col("truth"))
    return told.select(F.col("_key").alias(key), "fold", "foretold", F.col("truth").alias(wanted), off("foretold").alias("off"), off("constant").alias("off_constant"))
