"""Folds for held-out evaluation; sessions are never split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import fresh
from . import ordered

#: Sessions up to which folds are dealt on the driver and broadcast; beyond, the same folds come from sizes alone.
BROADCAST_ROWS = 200_000
#: Distinct session sizes that are held on the driver, and copies of a session's fold for a join with its frames.
MAX_SIZES, SALT = 1_000_000, 8
#: Rows of a part that a task orders, about; digits of a hash by which buckets are cut at most.
PART_ROWS, MAX_DIGITS = 250_000, 3
#: Sessions up to which their folds are broadcast, however they were dealt.
BROADCAST_FOLDS = 1_000_000


def _greedy(rows: list, k: int) -> list[tuple]:
    """rows (unit, n), the largest first: each goes into the lightest fold, the lowest number on ties."""
    weight, out = [0] * k, []
    for unit, n in rows:
        fold = weight.index(min(weight))
        weight[fold] += n
        out.append((unit, n, fold))
    return out


def _cycles(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """sizes (n, sessions), the largest first -> (n, start, folds): from place start on, in the order of all sessions,
    those of n rows take turns at these folds, up to the next start. Of m equal sessions the r-th goes to the fold of the
    r-th smallest (weight + i * n, fold), i from 0 on: the lightest folds take turns until the next one joins them."""
    weight, start, out = [0] * k, 0, []
    for n, m in sizes:
        waiting = sorted((w, f) for f, w in enumerate(weight))
        turns: list[tuple[int, int]] = []
        end = start + m
        while start < end:
            turns = sorted([*turns, waiting.pop(0)])
            # how often each may be taken before the next fold's turn
            takes = [end - start if not waiting else max(0, (waiting[0][0] - w) // n + (w % n == waiting[0][0] % n and f < waiting[0][1]) + (w % n != waiting[0][0] % n)) for w, f in turns]
            length = min(sum(takes), end - start) if waiting else end - start
            if length:
                # one who is due earlier has the earlier turn; within a cycle all are within n of each other
                out.append((n, start, [f for _, f in turns]))
            whole, rest = divmod(length, len(turns))
            turns = sorted((w + n * (whole + (i < rest)), f) for i, (w, f) in enumerate(turns))
            start += length
        for w, f in turns:
            weight[f] = w
    return out


def _counts(frames: DataFrame, session: str) -> DataFrame:
    return frames.groupBy(F.col(session).alias("_s")).agg(F.count(F.lit(1)).alias("_m"))


def _few(counts: DataFrame, k: int) -> DataFrame | None:
    """(_s, _m, fold), dealt on the driver; None for too many sessions."""
    rows = counts.orderBy(F.col("_m").desc(), "_s").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return None
    kind = counts.schema["_s"].dataType.simpleString()
    return counts.sparkSession.createDataFrame(_greedy([(r["_s"], r["_m"]) for r in rows], k), f"_s {kind}, _m long, fold int")


def _many(counts: DataFrame, k: int) -> DataFrame:
    """The same for any number of sessions: numbered in order by ranges, their folds by place from the cycles."""
    sizes = counts.groupBy("_m").count().orderBy(F.col("_m").desc()).limit(MAX_SIZES + 1).collect()
    if len(sizes) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} sizes of sessions")
    by_size: dict[int, list] = {}
    for n, start, turns in _cycles([(r["_m"], r["count"]) for r in sizes], k):
        by_size.setdefault(n, []).append((start, turns))
    cycles = counts.sparkSession.createDataFrame(list(by_size.items()), "_size long, _cycles array<struct<start:long,turns:array<int>>>")
    placed = ordered.numbered(counts, [-F.col("_m"), F.col("_s").isNotNull(), F.col("_s")], "_at").join(cycles, F.col("_m") == F.col("_size"))
    mine = F.element_at(F.filter("_cycles", lambda c: c["start"] < F.col("_at")), -1)
    return placed.select("_s", "_m", F.get(mine["turns"], ((F.col("_at") - 1 - mine["start"]) % F.size(mine["turns"])).cast("int")).alias("fold"))


def balanced(frames: DataFrame, session: str, k: int) -> DataFrame:
    """(session, n, fold): the largest session first, each into the lightest fold, the lowest number on ties."""
    counts = _counts(frames, session)
    found = _few(counts, k)
    return (_many(counts, k) if found is None else found).select(F.col("_s").alias(session), F.col("_m").alias("n"), "fold")


def dealt(df: DataFrame, session: str, k: int, source: DataFrame | None = None) -> DataFrame:
    """df with fold (in the stead of one that it has), by session, as `balanced` deals them. The folds of up to
    BROADCAST_FOLDS sessions are broadcast; those of more are joined on the session and a salt, so a hot session is not one task. source: the same rows with less
    work behind them, to count sessions in."""
    df = df.drop("fold")
    counts = _counts(df if source is None else source, session)
    of, salt, own_salt = fresh(df, "_session", "_salt", "_own_salt")
    found = _few(counts, k)
    if found is not None:
        return df.join(F.broadcast(found.select(F.col("_s").alias(of), "fold")), F.col(session).eqNullSafe(F.col(of))).drop(of)
    if counts.limit(BROADCAST_FOLDS + 1).count() <= BROADCAST_FOLDS:
        return df.join(F.broadcast(_many(counts, k).select(F.col("_s").alias(of), "fold")), F.col(session).eqNullSafe(F.col(of))).drop(of)
    salted = df.withColumn(own_salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALT)))
    table = _many(counts, k).select(F.col("_s").alias(of), "fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias(salt))
    return salted.join(table, F.col(session).eqNullSafe(F.col(of)) & (F.col(own_salt) == F.col(salt))).drop(of, salt, own_salt)


def round_robin(df: DataFrame, key: str, k: int, buckets: int = 64) -> DataFrame:
    """df with fold (in the stead of one that it has): rows numbered in the order of their hash's first byte modulo
    buckets, then of their hash, modulo k. Each such bucket is cut further by the hash, into as many parts as the rows
    need, so that a task orders PART_ROWS rows or so however many there are."""
    df = df.drop("fold")
    digest, bucket, at, n, start = fresh(df, "_hash", "_bucket", "_b", "_n", "_start")
    parts = max(buckets, -(-df.count() // PART_ROWS))
    digits = 1
    while 16 ** (2 + digits) < 16 * parts and digits < MAX_DIGITS:
        digits += 1
    named = F.md5(F.col(key).cast("string"))
    place = F.substring(named, 1, 2 + digits)
    hashed = df.withColumn(digest, F.unhex(named)).withColumn(bucket, place)
    # within a bucket hashes are in order, so what comes first among their digits cuts it in order
    before = Window.orderBy(F.conv(F.substring(at, 1, 2), 16, 10).cast("int") % buckets, at).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(place.alias(at)).agg(F.count(F.lit(1)).alias(n)).select(at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    row = F.row_number().over(Window.partitionBy(bucket).orderBy(digest, key))
    spark = df.sparkSession
    many = hashed.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), bucket)
    joined = many.withColumn(n, row).join(F.broadcast(starts), F.col(bucket) == F.col(at))  # a row per part of a bucket
    return joined.withColumn("fold", ((F.col(start) + F.col(n) - 1) % k).cast("long")).drop(digest, bucket, at, start, n)
