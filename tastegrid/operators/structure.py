"""Whether vectors fall into clusters: what k clusters explain of them, against columns that are shuffled each by itself."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import moments, ordered

ROUNDS, SEED = 60, 7
LEAST_SPREAD = 1e-12
#: Numbers that a part of the table holds, in bytes.
PART_BYTES = 16 << 20


def standardised(vectors: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """vectors with _z over the spreads of their columns (a column that does not vary stays 0), rows, and columns that
    vary."""
    m = moments.total(moments.collect(vectors.select(F.lit("all").alias("g"), F.col(vector).alias("x"), F.array(F.lit(0.0)).alias("y")), "x", "y", "g"))
    spread = np.sqrt(np.maximum(np.diag(m.covariance)[: m.dim], 0) / max(m.weight, 1.0))
    factor = np.where(spread > LEAST_SPREAD, 1 / np.maximum(spread, LEAST_SPREAD), 0.0)
    literal = lambda v: F.array(*[F.lit(float(x)) for x in v])
    z = F.zip_with(F.zip_with(vector, literal(m.mean[: m.dim]), lambda a, b: a - b), literal(factor), lambda a, b: a * b)
    return vectors.withColumn("_z", z), m.n, int((spread > LEAST_SPREAD).sum())


def shuffled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """rows (_r from 0 to n - 1 in a random order, _z): the same with every column moved by a permutation of its own, a
    step through the rows that has no divisor in common with n. No column is sorted."""
    rnd = np.random.default_rng(seed)
    width = len(rows.select("_z").first()[0])
    steps = []
    for _ in range(width):
        step = int(rnd.integers(1, max(n, 2)))
        while gcd(step, n) != 1:
            step += 1
        steps.append((step, int(rnd.integers(0, n))))
    a, b = (F.array(*[F.lit(s[i]).cast("long") for s in steps]) for i in (0, 1))
    cells = rows.select("_r", F.posexplode("_z").alias("_i", "_v"))
    # products of two numbers below n in parts, so that they do not leave 64 bits
    at = (F.get(a, F.col("_i")).cast("decimal(20,0)") * F.col("_r").cast("decimal(18,0)") % F.lit(n)).cast("long")
    moved = cells.select(((at + F.get(b, F.col("_i"))) % n).alias("_r"), "_i", "_v")
    return moved.groupBy("_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("_z"))


def structure(vectors: DataFrame, id: str, vector: str, *, clusters: tuple[int, ...] = (2, 3, 4), nulls: int = 5, rounds: int = ROUNDS) -> list[tuple[int, float, list[float]]]:
    """(k, explained, what is explained of each null) for every number of clusters: 1 less the share of the scatter that
    they leave, on standardised columns."""
    found, n, varied = standardised(vectors.select(F.col(id).alias("_id"), F.col(vector).cast("array<double>").alias("_x")), "_x")
    held = ordered.numbered(found.withColumn("_h", F.xxhash64("_id")), [F.col("_h"), F.col("_id")], "_at").select((F.col("_at") - 1).alias("_r"), "_z").persist()
    out: list[list[float]] = [[] for _ in clusters]
    # rounds are many and short: parts of PART_BYTES, and no more than there are tasks at once while rows are few
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, n * max(varied, 1) * 8 // PART_BYTES)
    try:
        for s in range(nulls + 1):
            rows = (held if s == 0 else shuffled(held, n, SEED + s)).select(array_to_vector("_z").alias("features")).coalesce(parts).persist()
            try:
                for i, k in enumerate(clusters):
                    left = KMeans(k=k, seed=SEED, maxIter=rounds).fit(rows).summary.trainingCost
                    out[i].append(1 - left / max(n * varied, 1))
            finally:
                rows.unpersist()
    finally:
        held.unpersist()
    return [(k, float(e[0]), [float(x) for x in e[1:]]) for k, e in zip(clusters, out, strict=True)]
