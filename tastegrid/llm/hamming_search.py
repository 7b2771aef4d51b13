"""Exact top-k search in Hamming space by incremental multi-index hashing.

A 64-bit code is cut into n segments, and each segment indexes the codes by its bits. Two codes that
differ in at most n * r + s bits differ in at most r bits in one of the segments 0 to s, or in less than
r in one of the others. So step (r, s) looks up, in segment s, the keys at distance exactly r from the query's,
verifies the codes found by their whole distance, and ends the queries whose kth verified distance is at most
n * r + s: nothing unseen can be nearer, or as near with a lesser id. Codes farther than a query's kth
distance so far are dropped in the lookup itself. The last step covers every code. Small radii are taken for all segments in one step.

Equal codes are one entry that holds the k least of their ids: no other copy can be among the k nearest.

Cases: a null or empty vector has no code and neither searches nor is found; shorter vectors count as filled up
with unset bits, longer ones raise; NaN is an unset bit; ties in distance go to the lesser id;
a row finds itself; fewer than k rows give as many results; rows that repeat an id count once; an empty table
gives an empty result; columns other than id and vector, or id and code, are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BITS = 64
#: Bits of a segment, near the logarithm of the number of codes: few tables where codes are many.
WIDE, NARROW, WIDE_FROM = 16, 8, 4096
K = 10
#: Radii of the first step, and the last radius that is taken for all segments at once.
FIRST_RADIUS, JOINT_RADIUS = 1, 3
SALTS = 64


def binary_codes(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): a bit per component, set where it is above 0, the first component's the highest."""
    v = F.col(vector)
    bit = lambda x: F.when((x > 0) & ~F.isnan(x), 1).otherwise(0).cast("long")
    packed = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x)))
    code = F.when(F.size(v) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} components"))).otherwise(F.expr(f"shiftleft(_packed, {BITS} - size(`{vector}`))"))
    rows = df.select(F.col(id).cast("long").alias("_id"), F.col(vector)).filter(F.col("_id").isNotNull() & (F.size(v) > 0))
    return rows.withColumn("_packed", packed).select(F.col("_id").alias("id"), code.cast("long").alias("code")).distinct()


def _least(rows: DataFrame, by: list[str], order: list[Column], k: int, salt: Column | None = None) -> DataFrame:
    """The first k rows of each group: first of each salted part of a group, then of what these leave."""
    if salt is not None:
        part = Window.partitionBy(*by, "_salt").orderBy(*order)
        rows = rows.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= k).drop("_salt", "_rank")
    whole = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def search(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """codes (id, code), queries (id, code): a row per query and rank with query_id, rank, neighbour_id, distance."""
    entries = _least(codes, ["code"], [F.col("id")], k, F.pmod(F.xxhash64("id"), F.lit(SALTS))).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = written(entries, "codes")
    width = WIDE if entries.count() >= WIDE_FROM else NARROW
    n_segments = BITS // width
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.expr(f"shiftrightunsigned(code, segment * {width}) & {(1 << width) - 1}").alias("key")
    segments = lambda numbers: F.explode(F.array(*map(F.lit, numbers))).alias("segment")
    index = written(entries.select("code", segments(range(n_segments))).select("segment", key, "code"), "segments")
    kind = "array<struct<distance:int,id:bigint>>"
    waiting = written(queries.select("code").distinct().withColumn("best", F.array().cast(kind)), "queries")
    every = range(n_segments)
    steps = [(range(FIRST_RADIUS + 1), every)] + [((r,), every) for r in range(FIRST_RADIUS + 1, JOINT_RADIUS + 1)] + [((r,), (s,)) for r in range(JOINT_RADIUS + 1, width + 1) for s in every]
    found = []
    for radii, numbers in steps:
        bits = np.bitwise_count(np.arange(1 << width))
        masks = ", ".join(f"{m}L" for m in np.flatnonzero((bits >= min(radii)) & (bits <= max(radii))))
        flips = F.expr(f"explode(array({masks}))").alias("mask")
        limit = F.when(F.size("best") >= k, F.get("best", k - 1)["distance"]).otherwise(BITS).alias("limit")
        # Spark's size estimate knows nothing of the flips: spread the queries, and join by shuffle
        probes = waiting.repartition(parts, "code").select(F.col("code").alias("query"), "code", limit, segments(numbers)).select("query", "limit", "segment", key, flips)
        sought = probes.select("query", "limit", F.col("segment").alias("_s"), F.expr("key ^ mask").alias("_k"))
        near = (F.col("_s") == F.col("segment")) & (F.col("_k") == F.col("key")) & (F.bit_count(F.col("query").bitwiseXOR(F.col("code"))) <= F.col("limit"))
        hits = sought.hint("merge").join(index, near).select("query", "code").distinct()
        rated = hits.join(entries, "code").select("query", F.expr("bit_count(query ^ code)").alias("distance"), F.explode("ids").alias("id"))
        before = waiting.select(F.col("code").alias("query"), F.inline("best"))
        top = _least(rated.unionByName(before).distinct(), ["query"], [F.col("distance"), F.col("id")], k)
        best = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("_best"))
        state = written(waiting.select("code").join(best, F.col("code") == F.col("query"), "left").select("code", F.coalesce("_best", F.array()).cast(kind).alias("best")), "step")
        covered = n_segments * max(radii) + max(numbers)
        settled = (F.size("best") >= k) & (F.get("best", k - 1)["distance"] <= covered) if covered < BITS else F.lit(True)
        found.append(state.filter(F.coalesce(settled, F.lit(False))))
        waiting = state.filter(~F.coalesce(settled, F.lit(False)))
        if waiting.isEmpty():
            break
    answers = found[0]
    for part in found[1:]:
        answers = answers.unionByName(part)
    ranked = queries.distinct().join(answers, "code").select(F.col("id").alias("query_id"), F.posexplode("best").alias("_at", "_best"))
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_best")["id"].alias("neighbour_id"), F.col("_best")["distance"].alias("distance"))

