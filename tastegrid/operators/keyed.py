"""Keyed logs and tables: newest wins, upserts, field merges, renames, purges, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key. order is descending priority; it must not tie."""
    w = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def journal(log: DataFrame, key: list[str], newest: list[Column], trained: str, trained_at: str) -> DataFrame:
    """The newest row of each key, with what the key's earlier rows say about training: a flag that stays set and
    the first instant."""
    whole = Window.partitionBy(*key)
    marked = log.withColumn(trained, F.max(trained).over(whole)).withColumn(trained_at, F.min(trained_at).over(whole))
    return latest(marked, key, newest)


def upsert(base: DataFrame, incoming: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """incoming over base by key; an existing row keeps its values of the kept columns."""
    a, b = base.alias("a"), incoming.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    new = F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.when(new & F.lit(c not in kept), F.col(f"b.{c}")).otherwise(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(c)
    return joined.select(*[pick(c) for c in base.columns])


def folded(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of over where a key is in both."""
    rest = base.join(over.select(key).distinct(), key, "left_anti")
    return rest.unionByName(over)


def merged_fields(log: DataFrame, key: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """Per key and field the last value that is not null, as order goes."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in fields]
    return log.groupBy(*key).agg(*last)


def moved(marks: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Keys renamed (old to new) all at once, so that swaps work; a row at a target that does not move is replaced."""
    m = moves.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    joined = marks.join(m, F.col(key) == F.col("_old"), "left")
    targets = m.join(marks.select(F.col(key).alias("_has")), F.col("_old") == F.col("_has"), "left_semi").select(F.col("_new").alias("_target")).distinct()
    stays = joined.filter("_old is null").join(targets, F.col(key) == F.col("_target"), "left_anti")
    goes = joined.filter("_old is not null")
    return stays.unionByName(goes).withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def state_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of after that are new or differ in a field, with whether they are new."""
    old = before.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = after.join(old, F.col(key) == F.col("_key"), "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    return joined.filter(F.col("_key").isNull() | differs).select(key, *fields, F.col("_key").isNull().alias("is_new"))


def purged(marks: DataFrame, known: DataFrame, key: str, applied: str) -> DataFrame:
    """Marks that are not applied and whose key is still known."""
    return marks.filter(~F.col(applied)).join(known.select(key).distinct(), key, "left_semi")
