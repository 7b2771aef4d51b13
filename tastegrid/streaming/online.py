"""Structured Streaming: online ratings, upserts by micro-batch, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyed import latest
from ..operators.ranking import K_FACTOR, expected, seeded
from ..sources.packs import Log


def _play(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rating = dict(zip(*state.get, strict=True)) if state.exists else {}
    touched: set[str] = set()
    for duel in pd.concat(list(batches)).sort_values("event_id").itertuples(index=False):
        w, l = duel.winner, duel.loser  # noqa: E741
        a, b = rating.get(w, seeded(getattr(duel, "winner_score", None))), rating.get(l, seeded(getattr(duel, "loser_score", None)))
        gain = K_FACTOR * (1 - expected(a, b))
        rating[w], rating[l] = a + gain, b - gain
        touched |= {w, l}
    state.update((list(rating), list(rating.values())))
    yield pd.DataFrame({"league": key[0], "id": sorted(touched), "rating": [rating[i] for i in sorted(touched)]})


def elo_stream(duels: DataFrame) -> DataFrame:
    """Ratings that a stream of duels (league, event_id, winner, loser) changes, a row per player and batch. The
    two sides of a duel share their league's state. Players that are new start from winner_score and loser_score, from
    0 to 1, where the stream has them."""
    return duels.groupBy("league").applyInPandasWithState(_play, "league long, id string, rating double", "ids array<string>, ratings array<double>", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str):
    """Starts a query that keeps, in a Parquet log at target, each batch's newest row of every key with the number
    of its batch. A batch that runs again overwrites its own folder, so replays change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        newest = latest(batch, key, [F.col(c).desc() for c in order])
        newest.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, target: str, key: list[str], order: list[str]) -> DataFrame:
    """The table that the log of upsert_batches stands for."""
    return latest(spark.read.option("basePath", target).parquet(f"{target}/batch=*"), key, [*[F.col(c).desc() for c in order], F.col("batch").desc()])


def append_batches(stream: DataFrame, log: Log, order: list[str], checkpoint: str):
    """Starts a query that appends each batch's newest row of every key to a log of packs; a batch that runs again is not
    appended again."""

    def write(batch: DataFrame, number: int) -> None:
        log.append(latest(batch, log.key, [F.col(c).desc() for c in order]), batch=f"{log.store.root.rsplit('/', 1)[-1]}-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and type; rows later than the watermark allows are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
