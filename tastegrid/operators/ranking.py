"""Ranking from duels: Bradley-Terry strengths, Elo ratings, the next pair to ask for, rank profiles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.window import Window

from ..functions import arrays
from ..functions.jsmath import logistic
from ..sources.shared import shared_dir
from . import moments, ordered

#: Elo (fixed values): the gain of a sure surprise, the middle rating, the spread of a rating and of the seeds.
K_FACTOR, START, SPREAD, SEED_SPREAD = 32.0, 1500.0, 400.0, 400.0
#: Bradley-Terry (fixed values): full-batch steps, their length, and the pull towards 0.
STEPS, RATE, DECAY = 800, 0.1, 0.01
#: Distinct (winner, loser) pairs of one league that a single task fits; larger leagues are fitted by joins and sums, in
#: at most so many steps, until no strength moves further than this.
MAX_PAIRS, SPREAD_STEPS, SETTLED = 1_000_000, 400, 1e-5
#: Rank profiles (fixed values): shares of the scores below which the stars from 5 down begin; duels that a profile
#: needs; share of the duels held out; fewest duels that an accuracy is told for, held out and trained on.
STAR_SHARES = ((0.9, 5), (0.75, 4), (0.5, 3), (0.3, 2), (0.1, 1))
MIN_DUELS, HOLDOUT, MIN_TEST, MIN_TRAIN = 10, 0.2, 5, 10


def expected(a: float, b: float) -> float:
    return 1.0 / (1.0 + 10.0 ** ((b - a) / SPREAD))


def seeded(score: float | None) -> float:
    """The rating that a score from 0 to 1 starts from; unknown: the middle."""
    return START + ((0.5 if score is None or score != score else score) - 0.5) * SEED_SPREAD


class Likelihood:
    """The penalised likelihood of strengths, from how often each pair ended each way."""

    def __init__(self, winners: np.ndarray, losers: np.ndarray, counts: np.ndarray, n: int, decay: float) -> None:
        self.w, self.l, self.c, self.n, self.decay = winners, losers, counts, n, decay

    def value(self, theta: np.ndarray) -> float:
        return -float((self.c * np.logaddexp(0, self.spread(-theta))).sum() + self.decay / 2 * (theta * theta).sum())

    def spread(self, v: np.ndarray) -> np.ndarray:
        return v[self.w] - v[self.l]

    def gathered(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, v, self.n) - np.bincount(self.l, v, self.n)

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        return self.gathered(self.c / (1 + np.exp(self.spread(theta)))) - self.decay * theta

    def newton_step(self, theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """The curvature's answer to the gradient, by conjugate gradients."""
        p = 1 / (1 + np.exp(-self.spread(theta)))
        curve = self.c * p * (1 - p)
        step, rest = np.zeros(self.n), gradient.copy()
        direction, size = rest.copy(), rest @ rest
        for _ in range(4 * self.n + 10):
            if size <= 1e-24 * max(1.0, gradient @ gradient):
                break
            bent = self.gathered(curve * self.spread(direction)) + self.decay * direction
            share = size / (direction @ bent)
            step, rest = step + share * direction, rest - share * bent
            size, before = rest @ rest, size
            direction = rest + size / before * direction
        return step

    def maximum(self) -> np.ndarray:
        theta = np.zeros(self.n)
        for _ in range(200):
            gradient = self.gradient(theta)
            if np.abs(gradient).max() < 1e-10 * max(1.0, self.c.sum()):
                break
            step, share, at = self.newton_step(theta, gradient), 1.0, self.value(theta)
            while self.value(theta + share * step) < at and share > 1e-6:
                share /= 2
            theta = theta + share * step
        return theta


def strengths(winners: np.ndarray, losers: np.ndarray, counts: np.ndarray, n: int, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Bradley-Terry strengths, centred on 0: full-batch gradient steps over pair counts, as specified. Where ids have
    so many duels that these steps overshoot, the maximum that they look for, by Newton's method."""
    likelihood, theta = Likelihood(winners, losers, counts, n, decay), np.zeros(n)
    duels = np.bincount(winners, counts, n) + np.bincount(losers, counts, n)
    # the curvature is at most half the most duels of an id: below this bound no step overshoots
    safe, at = rate * (duels.max() / 2 + decay) <= 2, likelihood.value(theta)
    for _ in range(steps):
        theta = theta + rate * likelihood.gradient(theta)
        if not safe:
            before, at = at, likelihood.value(theta)
            if not at >= before:
                theta = likelihood.maximum()
                break
    return theta - theta.mean()


def bradley_terry(duels: DataFrame, league: str) -> DataFrame:
    """duels (league, winner, loser): (league, id, strength, duels). Duels are collapsed to pair counts first. A league of
    up to MAX_PAIRS of them meets in one task; a larger one is fitted by steps over all tasks, to the maximum that the
    specified steps look for."""
    pairs = duels.groupBy(league, "winner", "loser").agg(F.count(F.lit(1)).alias("n"))
    sizes = pairs.groupBy(league).agg(F.count(F.lit(1)).alias("_pairs"))
    large = [r[league] for r in sizes.filter(F.col("_pairs") > MAX_PAIRS).select(league).collect()]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((group["winner"], group["loser"])))
        w, l = np.searchsorted(ids, group["winner"]), np.searchsorted(ids, group["loser"])  # noqa: E741
        n = group["n"].to_numpy(dtype=float)
        met = np.bincount(w, n, len(ids)) + np.bincount(l, n, len(ids))
        return pd.DataFrame({league: group[league].iloc[0], "id": ids, "strength": strengths(w, l, n, len(ids)), "duels": met.astype(np.int64)})

    kind = duels.schema
    schema = f"{league} {kind[league].dataType.simpleString()}, id {kind['winner'].dataType.simpleString()}, strength double, duels long"
    if not large:
        return pairs.groupBy(league).applyInPandas(fit, schema)
    in_large = F.coalesce(F.col(league).isin(*large), F.lit(False))
    return pairs.filter(~in_large).groupBy(league).applyInPandas(fit, schema).unionByName(spread_strengths(pairs.filter(in_large), league))


def spread_strengths(pairs: DataFrame, league: str, decay: float = DECAY) -> DataFrame:
    """pairs (league, winner, loser, n): (league, id, strength, duels), the maximum of the penalised likelihood by
    accelerated steps whose lengths are bounds on each id's curvature. A step is two joins of pair counts with strengths
    and a sum by id; strengths go to the shared folder after each, so lineage does not grow and lost executors cost a
    step."""
    spark, folder = pairs.sparkSession, f"{shared_dir(pairs.sparkSession)}/strengths-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    side = lambda a, b, won: pairs.select(F.col(league).alias("g"), F.col(a).alias("a"), F.col(b).alias("b"), F.when(F.lit(won), F.col("n")).otherwise(0).alias("won"), "n")
    both = side("winner", "loser", True).unionByName(side("loser", "winner", False))
    edges = kept(both.groupBy("g", "a", "b").agg(F.sum("won").alias("won"), F.sum("n").alias("n")), "pairs")
    # the curvature of a pair is a quarter at most, and that of the whole at most twice its diagonal
    nodes = edges.groupBy("g", "a").agg((F.sum("n") / 2 + decay).alias("bound"), F.sum("n").alias("met"))
    state = kept(nodes.select("g", "a", "bound", "met", F.lit(0.0).alias("theta"), F.lit(0.0).alias("ahead")), "0")
    for step in range(1, SPREAD_STEPS + 1):
        mine, other = state.select("g", "a", F.col("ahead").alias("ya")), state.select("g", F.col("a").alias("b"), F.col("ahead").alias("yb"))
        pull = edges.join(mine, ["g", "a"]).join(other, ["g", "b"]).groupBy("g", "a").agg(F.sum(F.col("won") - F.col("n") * logistic(F.col("ya") - F.col("yb"))).alias("pull"))
        theta = F.col("ahead") + (F.col("pull") - decay * F.col("ahead")) / F.col("bound")
        moved = state.join(pull, ["g", "a"]).withColumn("new", theta)
        state = kept(moved.select("g", "a", "bound", "met", F.col("new").alias("theta"), (F.col("new") + (step - 1) / (step + 2) * (F.col("new") - F.col("theta"))).alias("ahead"), F.abs(F.col("new") - F.col("theta")).alias("far")), str(step))
        if (state.agg(F.max("far")).first()[0] or 0.0) < SETTLED:
            break
    means = state.groupBy("g").agg(F.avg("theta").alias("mean"))
    return state.join(F.broadcast(means), "g").select(F.col("g").alias(league), F.col("a").alias("id"), (F.col("theta") - F.col("mean")).alias("strength"), F.col("met").cast("long").alias("duels"))


def elo(duels: DataFrame, league: str, order: str, seeds: DataFrame | None = None) -> DataFrame:
    """(league, id, rating, n) after each league's duels in order; n: duels of the id. seeds (league, id, score) name
    what ids start from. Winner and loser share a state, so a league's duels go one after the other; they stream
    through a task in order and only the ratings are held."""
    kind = duels.schema
    none = F.lit(None).cast(kind["winner"].dataType)
    rows = duels.select(F.col(league), F.lit(1).alias("_kind"), F.col(order).alias("_order"), "winner", "loser", F.lit(None).cast("double").alias("_score"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select(F.col(league), F.lit(0).alias("_kind"), F.lit(None).cast(kind[order].dataType).alias("_order"), F.col("id").alias("winner"), none.alias("loser"), F.col("score").cast("double").alias("_score")))
    ready = rows.repartition(league).sortWithinPartitions(league, "_kind", "_order").select(league, "_kind", "winner", "loser", "_score")

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rating, met = None, {}, {}

        def told() -> pd.DataFrame:
            return pd.DataFrame({league: [now] * len(rating), "id": list(rating), "rating": list(rating.values()), "n": [met.get(i, 0) for i in rating]})

        for batch in batches:
            for name, kind_, w, l, score in batch.itertuples(index=False):  # noqa: E741
                if now is None or name != now:
                    if rating:
                        yield told()
                    now, rating, met = name, {}, {}
                if kind_ == 0:
                    rating[w] = seeded(score)
                    continue
                a, b = rating.get(w, START), rating.get(l, START)
                gain = K_FACTOR * (1 - expected(a, b))
                rating[w], rating[l] = a + gain, b - gain
                met[w], met[l] = met.get(w, 0) + 1, met.get(l, 0) + 1
        if rating:
            yield told()

    schema = StructType().add(league, kind[league].dataType).add("id", kind["winner"].dataType).add("rating", DoubleType()).add("n", LongType())
    return ready.mapInPandas(play, schema)


def next_pair(ratings: DataFrame, league: str, turn: int = 0) -> DataFrame:
    """ratings (league, id, rating, n): per league the pair (a, b) to ask for next. a: one of the quarter with the
    fewest duels, drawn by hash; b: the id with the nearest rating. Leagues with one id have no pair."""
    # the quarter's border from counts by number of duels, then places only among those at the border
    met = F.coalesce("n", F.lit(0))
    counts = ratings.groupBy(F.col(league).alias("_l"), met.alias("_met")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_l").orderBy("_met")
    seen = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_size", F.greatest(F.lit(1), F.floor(F.sum("_c").over(Window.partitionBy("_l")) / 4)))
    border = seen.filter(F.col("_upto") >= F.col("_size")).groupBy("_l").agg(F.min("_met").alias("_border"), F.min_by(F.col("_size") - F.col("_upto") + F.col("_c"), "_met").alias("_more"))
    near = ratings.join(border, F.col(league) == F.col("_l")).filter(met <= F.col("_border"))
    tied = ordered.numbered(near.filter(met == F.col("_border")), [F.col(league), F.col("id")], "_at")
    starts = tied.groupBy(F.col(league).alias("_m")).agg(F.min("_at").alias("_start"))
    least = tied.join(starts, F.col(league) == F.col("_m")).filter(F.col("_at") - F.col("_start") < F.col("_more")).drop("_at", "_m", "_start")
    pool = near.filter(met < F.col("_border")).unionByName(least)
    draw = F.struct(F.md5(F.concat_ws(":", F.col(league), F.col("id"), F.lit(turn)).cast("binary")), F.col("id"))
    first = pool.drop("_l", "_border", "_more").groupBy(league).agg(F.min_by(F.struct("id", "rating"), draw).alias("_a"))
    others = ratings.join(first, league).filter(F.col("id") != F.col("_a")["id"])
    return others.groupBy(league, F.col("_a")["id"].alias("a")).agg(F.min_by("id", F.struct(F.abs(F.col("rating") - F.col("_a")["rating"]), F.col("id"))).alias("b"))


@dataclass(frozen=True)
class RankProfile:
    """A linear head over vectors with what turns its scores into stars."""

    weights: list[float]
    bias: float
    mean: float
    spread: float
    cuts: tuple[tuple[float, int], ...]
    duels: int
    photos: int
    accuracy: float | None

    def score(self, x):
        return arrays.dot(x, F.array(*[F.lit(w) for w in self.weights])) + self.bias

    def merit(self, x):
        """0 to 1: the logistic of the standardised score."""
        return logistic((self.score(x) - self.mean) / self.spread)

    def stars(self, x):
        merit, out = self.merit(x), F.lit(0)
        for least, n in sorted(self.cuts):
            out = F.when(merit >= least, n).otherwise(out)
        return out


def _half_up(v: float, digits: int) -> float:
    return float(np.floor(v * 10**digits + 0.5) / 10**digits)


def _head(photos: DataFrame, duels: DataFrame, penalty: float) -> tuple[np.ndarray, float]:
    """A ridge head from the vectors of the duelled to their strengths."""
    fitted = bradley_terry(duels.withColumn("_league", F.lit(0)), "_league").select("id", F.array("strength").alias("y"), F.lit("all").alias("g"))
    m = moments.total(moments.collect(photos.select("id", "x").join(fitted, "id"), "x", "y", "g"))
    b, c = moments.ridge(m, penalty, per_weight=False)
    return b[:, 0], float(c[0])


def _accuracy(photos: DataFrame, duels: DataFrame, penalty: float, holdout: float) -> float | None:
    """The share of held-out duels whose winner has the higher score of a head that has not seen them. Duels are held
    out by a hash of their id; None where either part is too small."""
    u = F.conv(F.substring(F.md5(F.col("duel").cast("string")), 1, 8), 16, 10).cast("double") / float(2**32)
    test, train = duels.filter(u < holdout), duels.filter(u >= holdout)
    if test.count() < MIN_TEST or train.count() < MIN_TRAIN:
        return None
    b, c = _head(photos, train, penalty)
    scored = photos.select("id", arrays.dot(F.col("x"), F.array(*[F.lit(float(w)) for w in b])).alias("s"))
    met = test.join(scored.toDF("winner", "_sw"), "winner").join(scored.toDF("loser", "_sl"), "loser")
    share = met.agg(F.avg((F.col("_sw") > F.col("_sl")).cast("double"))).first()[0]
    return None if share is None else _half_up(share, 4)


def rank_profile(photos: DataFrame, duels: DataFrame, penalty: float = 1.0, holdout: float = HOLDOUT) -> RankProfile:
    """photos (id, x), duels (duel, winner, loser): strengths of the duelled, a linear head on their vectors, stars at
    shares of their scores, and the accuracy on held-out duels. Fewer than MIN_DUELS duels between known photos raise."""
    known = photos.select("id")
    valid = duels.select("duel", "winner", "loser").join(known.toDF("winner"), "winner", "left_semi").join(known.toDF("loser"), "loser", "left_semi")
    n = valid.count()
    if n < MIN_DUELS:
        raise ValueError(f"{n} duels between known photos; a profile needs {MIN_DUELS}")
    b, c = _head(photos, valid, penalty)
    ids = valid.select(F.explode(F.array("winner", "loser")).alias("id")).distinct()
    weights = [_half_up(float(w), 6) for w in b]
    raw = photos.join(ids, "id", "left_semi").select((arrays.dot(F.col("x"), F.array(*[F.lit(float(w)) for w in b])) + c).alias("s"))
    norm = raw.agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), F.percentile_approx("s", [p for p, _ in STAR_SHARES], 100_000).alias("q")).first()
    spread = norm["sd"] or 1.0
    cuts = tuple((_half_up(1 / (1 + float(np.exp(-(q - norm["mean"]) / spread))), 4), stars) for q, (_, stars) in zip(norm["q"], STAR_SHARES, strict=True))
    return RankProfile(weights, _half_up(c, 6), _half_up(norm["mean"], 6), _half_up(spread, 6), cuts, n, norm["n"], _accuracy(photos, valid, penalty, holdout))
