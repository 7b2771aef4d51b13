"""Orders over whole tables without a task that holds them: numbering, neighbours, medians."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import fresh
from ..sources.shared import shared_dir

#: Rows that a median is picked from at last, and the most rounds that narrow its bracket.
BRACKET_ROWS, ROUNDS = 50_000, 8


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with name (in the stead of a column of that name that the order does not need): 1, 2, ... in ascending order,
    which must not tie. Rows are dealt by ranges, sorted there and written once to the shared folder with their range and
    their number in it; ranges then move up by the counts of the ranges before. What is numbered is what was written, so
    sums whose last bits differ from one computation to the next can neither lose a row nor give a place twice."""
    spark = df.sparkSession
    mark, at, n, start = fresh(df, "_mark", "_range", "_n", "_start")
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    # the id has the range in its upper bits and the number within it in the lower 33
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    ranged.write.parquet(folder)
    held = spark.read.schema(ranged.schema).parquet(folder).withColumn(at, F.shiftright(mark, 33))
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(at).agg(F.count(F.lit(1)).alias(n))
    starts = counts.select(at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))  # a row per range
    joined = held.join(F.broadcast(starts), at)
    return joined.withColumn(name, (F.col(start) + F.col(mark).bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop(mark, at, start)


def neighbours(df: DataFrame, id: str, value: str) -> DataFrame:
    """(id, value, below, level, above): structs (v, id) of the least id with the next lower, the same and the next higher
    value, which `level` has from another row. A row without a value has none of them."""
    # of a value's ids the two least are enough, as whoever asks is not both; each task passes on no more of a value
    rows = df.select(F.col(id).alias("_i"), F.col(value).alias("_v")).filter("_v IS NOT NULL").distinct()
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_v").orderBy("_i"))).filter("_k <= 2")
    two = ranked.groupBy("_v").agg(F.min("_i").alias("_a"), F.max("_i").alias("_b")).withColumn("_b", F.nullif("_b", "_a"))
    values = numbered(two, [F.col("_v")], "_n")
    side = lambda step, name: values.select((F.col("_n") + step).alias("_n"), F.struct(F.col("_v").alias("v"), F.col("_a").alias("id")).alias(name))
    near = values.join(side(1, "below"), "_n", "left").join(side(-1, "above"), "_n", "left").drop("_n")
    other = F.when(F.col("_i") == F.col("_a"), F.col("_b")).otherwise(F.col("_a"))
    level = F.when(other.isNotNull(), F.struct(F.col("_v").alias("v"), other.alias("id")))
    asking = df.select(F.col(id).alias("_i"), F.col(value).alias("_w"))
    return asking.join(near, F.col("_w") == F.col("_v"), "left").select(F.col("_i").alias(id), F.col("_w").alias(value), "below", level.alias("level"), "above")


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of a column, null values left out: a bracket about the middle is narrowed by approximate
    quantiles until few rows are in it, which are sorted."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    n, low, high, below, inside = whole["n"], whole["a"], whole["b"], 0, whole["n"]
    if not n:
        return None
    ranks = ((n - 1) // 2, n // 2)
    for _ in range(ROUNDS):
        if inside <= BRACKET_ROWS or low == high:
            break
        at = [min(1.0, max(0.0, (r - below) / inside + off)) for r, off in ((ranks[0], -0.002), (ranks[1], 0.002))]
        q = values.filter(F.col("v").between(low, high)).agg(F.percentile_approx("v", at, 10_000).alias("q")).first()["q"]
        counts = values.agg(F.count_if(F.col("v") < q[0]).alias("below"), F.count_if(F.col("v").between(q[0], q[1])).alias("inside")).first()
        if not counts["below"] <= ranks[0] <= ranks[1] < counts["below"] + counts["inside"] or counts["inside"] == inside:
            break
        (low, high), below, inside = q, counts["below"], counts["inside"]
    bracket = values.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    upto = below + F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = bracket.withColumn("_upto", upto).agg(*[F.min(F.when(F.col("_upto") > r, F.col("v"))).alias(f"r{i}") for i, r in enumerate(ranks)]).first()
    return (found["r0"] + found["r1"]) / 2
