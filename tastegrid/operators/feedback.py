"""Predicted against kept values: weights, summaries, offsets, style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.jsmath import clamp
from .ordered import median
from .sessions import beside

TOLERANCE = 0.5
MIN_SESSIONS, MIN_SIGMA, SHRINK = 4, 2.0, 0.5


def in_sample(predicted_at: Column, trained_at: Column, stored: Column) -> Column:
    """Whether a prediction is of a frame the model had seen: from the instants where both are known, as a
    prediction later than its training is held out; else as stored, null being false."""
    return F.when(predicted_at.isNotNull() & trained_at.isNotNull(), ~(predicted_at > trained_at)).otherwise(F.coalesce(stored, F.lit(False)))


def correction_weights(observed: DataFrame, spreads: DataFrame) -> DataFrame:
    """observed (file, param, predicted, actual), spreads (param, spread): (file, z, weight). z is the mean
    correction in spreads; the weight is z over the median z, between 1/4 and 3."""
    z = beside(observed, spreads, "param").groupBy("file").agg(F.avg(F.abs(F.col("actual") - F.col("predicted")) / F.col("spread")).alias("z"))
    z = z.persist()  # read some times over for the exact median
    middle = median(z, "z")
    return z.select("file", "z", clamp(F.col("z") / F.lit(middle), 0.25, 3.0).alias("weight"))


def summary(observed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per parameter: compared, kept, engaged (either side off neutral), kept among these, bias, journey."""
    off = F.col("actual") - F.col("predicted")
    kept = F.abs(off) <= tolerance
    engaged = (F.abs(F.col("actual") - F.col("neutral")) > tolerance) | (F.abs(F.col("predicted") - F.col("neutral")) > tolerance)
    return observed.groupBy("param").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(kept).alias("kept"), F.count_if(engaged).alias("engaged"), F.count_if(engaged & kept).alias("engaged_kept"),
        F.avg(off).alias("bias"), (1 - F.sum(F.abs(off)) / F.sum(F.abs(F.col("actual") - F.col("neutral")))).alias("journey"),
    )


def offsets(observed: DataFrame) -> DataFrame:
    """(param, n_sessions, sigma, offset): the median over sessions of session medians, where a sign test over at
    least MIN_SESSIONS sessions reaches MIN_SIGMA, shrunk; else 0."""
    by_session = observed.groupBy("session", "param").agg(F.median(F.col("actual") - F.col("predicted")).alias("m"))
    up, down = F.count_if(F.col("m") > 0), F.count_if(F.col("m") < 0)
    decided = up + down
    sigma = F.when(decided > 0, F.abs(up - down) / F.sqrt(decided)).otherwise(0.0)
    agg = by_session.groupBy("param").agg(F.count(F.lit(1)).alias("n_sessions"), sigma.alias("sigma"), F.median("m").alias("_middle"))
    enough = (F.col("n_sessions") >= MIN_SESSIONS) & (F.col("sigma") >= MIN_SIGMA)
    return agg.select("param", "n_sessions", "sigma", F.when(enough, F.col("_middle") * SHRINK).otherwise(0.0).alias("offset"))


def style(residuals: DataFrame) -> DataFrame:
    """residuals (session, param, value): positive-part shrinkage of the mean of session means. The standard
    error is over sessions from three on, else over frames."""
    by_session = residuals.groupBy("session", "param").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    frames = residuals.groupBy("param").agg(F.stddev_samp("value").alias("frame_sd"))
    agg = by_session.groupBy("param").agg(F.count(F.lit(1)).alias("n_sessions"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")).join(frames, "param")
    se = F.when(F.col("n_sessions") >= 3, F.col("sd")).otherwise(F.col("frame_sd")) / F.sqrt("n_sessions")
    return agg.withColumn("se", se).withColumn("shrink", F.when(F.col("mean") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("se") * F.col("se") / (F.col("mean") * F.col("mean"))))).select("param", "n_sessions", "mean", "se", "shrink", (F.col("mean") * F.col("shrink")).alias("offset"))


def weighted_percentile(df: DataFrame, group: str, value: str, weight: Column, p: float) -> DataFrame:
    """(group, percentile): the first value, in order, at which the weights so far reach p of the group's. Weights are
    summed by value before a group is ordered, so a group is as many rows as it has values."""
    sums = df.groupBy(group, value).agg(F.sum(weight).alias("_w"))
    whole = Window.partitionBy(group)
    seen = sums.withColumn("_seen", F.sum("_w").over(whole.orderBy(value))).withColumn("_all", F.sum("_w").over(whole))
    return seen.filter(F.col("_seen") >= F.col("_all") * p).groupBy(group).agg(F.min(value).alias("percentile"))
