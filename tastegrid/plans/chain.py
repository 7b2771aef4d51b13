"""The develop chain as commands over named tables: what was kept, what it teaches, and the next predictions.

Tables in long form: predictions (file, session, param, predicted), edits (file, session, param, actual, neutral),
observations (both of them and, where there is one, at, an instant), style and offsets (param, offset).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import feedback, keyed, ordered
from ..registry import query
from ..sources.shared import shared_dir
from . import graph
from .base import OBSERVED, observed, r6


def init(edits: DataFrame, tolerance: float = feedback.TOLERANCE) -> DataFrame:
    """Training rows: the edits of frames that are off neutral in some parameter, as deltas."""
    edited = edits.filter(F.abs(F.col("actual") - F.col("neutral")) > tolerance).select("file").distinct()
    return edits.join(edited, "file", "left_semi").withColumn("delta", F.col("actual") - F.col("neutral"))


def observe(predictions: DataFrame, edits: DataFrame) -> DataFrame:
    """Observations: what was predicted beside what was kept; predictions of frames without edits are left out."""
    return predictions.join(edits.drop("session"), ["file", "param"])


def journal(observations: DataFrame, before: DataFrame, newest: str = "at") -> DataFrame:
    """The observations of before with the new ones over them, the newest of each file and parameter."""
    both = before.unionByName(observations, allowMissingColumns=True)
    return keyed.latest(both, ["file", "param"], [F.col(newest).desc_nulls_last(), F.col("actual").desc()])


def learn(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """Training rows with a shoot folded in: its frames' rows in the stead of older ones, and weighted by how much was
    corrected against the spread of each parameter (other rows weigh 1)."""
    spreads = rows.groupBy("param").agg(F.greatest(F.lit(1e-6), F.stddev_pop("delta")).alias("spread"))
    weights = feedback.correction_weights(observations, spreads).select("file", "weight")
    fresh = observations.withColumn("delta", F.col("actual") - F.col("neutral")).join(weights, "file", "left")
    old = rows.join(observations.select("file").distinct(), "file", "left_anti").withColumn("weight", F.lit(1.0))
    columns = ["file", "session", "param", "actual", "neutral", "delta", "weight"]
    return old.select(*columns).unionByName(fresh.select(*columns))


def style(observations: DataFrame) -> DataFrame:
    """What is added to predictions of a parameter alike in all sessions, shrunk by how much they agree."""
    residuals = observations.select("session", "param", (F.col("actual") - F.col("predicted")).alias("value"))
    return feedback.style(residuals)


def calibrate(observations: DataFrame) -> DataFrame:
    """Constant offsets that most sessions call for."""
    return feedback.offsets(observations)


def edit(predictions: DataFrame, offsets: DataFrame, strength: float = 1.0) -> DataFrame:
    """Predictions moved by the offset of their parameter, strength of the way; without one they stay."""
    moved = predictions.join(offsets.select("param", F.col("offset").alias("_offset")), "param", "left")
    return moved.withColumn("predicted", F.col("predicted") + strength * F.coalesce("_offset", F.lit(0.0))).drop("_offset")


def report(predictions: DataFrame, edits: DataFrame, tolerance: float = feedback.TOLERANCE) -> DataFrame:
    """Predicted against kept values by parameter, the worst journey first."""
    told = feedback.summary(observe(predictions, edits), tolerance)
    return ordered.numbered(told, [F.col("journey"), F.col("param")])


COMMANDS: dict[str, graph.Command] = {"init": init, "observe": observe, "journal": journal, "learn": learn, "style": style, "calibrate": calibrate, "edit": edit, "report": report}

#: One turn of refining: what was kept, the style it shows, predictions with it, constants anew, and what is then left.
REFINE = [
    {"id": "kept", "run": "observe", "reads": {"predictions": "predictions", "edits": "edits"}},
    {"id": "style", "run": "style", "reads": {"observations": "kept"}},
    {"id": "styled", "run": "edit", "reads": {"predictions": "predictions", "offsets": "style"}, "with": {"strength": 0.5}},
    {"id": "left", "run": "observe", "reads": {"predictions": "styled", "edits": "edits"}},
    {"id": "offsets", "run": "calibrate", "reads": {"observations": "left"}},
    {"id": "next", "run": "edit", "reads": {"predictions": "styled", "offsets": "offsets"}},
    {"id": "told", "run": "report", "reads": {"predictions": "next", "edits": "edits"}, "with": {"tolerance": 20000.0}},
]


@query("refine_chain", f"""WITH {OBSERVED}, m AS (SELECT session, param, avg(actual - predicted) AS m FROM observed GROUP BY 1, 2), f AS (SELECT param, stddev_samp(actual - predicted) AS fsd FROM observed GROUP BY 1),
  a AS (SELECT param, count(*) AS n, avg(m) AS mean, stddev_samp(m) AS sd FROM m GROUP BY 1), s AS (SELECT param, mean * CASE WHEN mean = 0 THEN 0 ELSE greatest(0, 1 - pow((CASE WHEN n >= 3 THEN sd ELSE fsd END) / sqrt(n), 2) / (mean * mean)) END AS style FROM a JOIN f USING (param)),
  o AS (SELECT file, session, param, predicted + 0.5 * style AS predicted, actual, neutral FROM observed JOIN s USING (param)), c AS (SELECT session, param, median(actual - predicted) AS m FROM o GROUP BY 1, 2),
  k AS (SELECT param, count(*) AS n, count(*) FILTER (m > 0) AS up, count(*) FILTER (m < 0) AS down, median(m) AS middle FROM c GROUP BY 1),
  z AS (SELECT param, CASE WHEN n >= 4 AND up + down > 0 AND abs(up - down) / sqrt(up + down) >= 2 THEN middle * 0.5 ELSE 0 END AS off FROM k),
  t AS (SELECT param, count(*) AS compared, avg(actual - predicted - off) AS bias, 1 - sum(abs(actual - predicted - off)) / sum(abs(actual - neutral)) AS journey FROM o JOIN z USING (param) GROUP BY 1)
  SELECT row_number() OVER (ORDER BY journey, param) AS place, param, compared, floor(bias * 1e3 + 0.501) / 1e3 AS bias, floor(journey * 1e6 + 0.501) / 1e6 AS journey FROM t""")
def refine_chain(spark, sf_dir):
    """One turn of refining over the orders: what is left of each parameter's errors."""
    o = observed(spark, sf_dir)
    tables = {"predictions": o.select("file", "session", "param", "predicted"), "edits": o.select("file", "session", "param", "actual", "neutral")}
    done = graph.run(spark, REFINE, COMMANDS, tables, f"{shared_dir(spark)}/refine-{uuid.uuid4().hex}")
    return done.results["told"].select("place", "param", "compared", (F.floor(F.col("bias") * 1e3 + 0.501) / 1e3).alias("bias"), r6(F.col("journey")).alias("journey"))
