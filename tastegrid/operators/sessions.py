"""Session context: means, deviations, levels; standardising over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from .moments import matrix

#: A spread counts as this at least; below DEGENERATE a column says nothing.
LEAST_SPREAD = 1e-6
DEGENERATE = 1e-9


#: Sessions whose sums a task holds before it passes them on.
HELD = 20_000
#: Facts (a row per value) that are brought to the driver and broadcast.
FEW_FACTS = 10_000


def means(frames: DataFrame, session: str, vector: str, file: str = "file") -> DataFrame:
    """(session, mean): element-wise mean of the vectors that are as long as the session's first (by file). Tasks sum
    by session and length; only these sums are shuffled, so a hot session is as many rows as there are tasks. A null
    vector is left out; one with a null or NaN number raises. Short vectors are averaged by column, without Python."""
    known = frames.filter(F.col(vector).isNotNull() & F.col(session).isNotNull())
    facts = known.agg(F.max(F.size(vector)).alias("width"), F.coalesce(F.bool_or(F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x))), F.lit(False)).alias("holes")).first()
    if not facts["holes"] and 0 < (facts["width"] or 0) <= PLAIN_COLUMNS:
        return _plain_means(frames, session, vector, file, facts["width"])
    return _summed_means(frames, session, vector, file)


def _summed_means(frames: DataFrame, session: str, vector: str, file: str) -> DataFrame:
    """The same for vectors of any length, summed in numpy."""
    kind = pa.schema([("key", pa.string()), ("file", pa.string()), ("n", pa.int64()), ("sum", pa.list_(pa.float64()))])

    def told(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([v[0] for v in held.values()], pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[2].tolist() for v in held.values()], pa.list_(pa.float64()))], schema=kind)

    def summed(batches):
        held: dict[tuple[str, int], tuple[str, int, np.ndarray]] = {}
        for batch in batches:
            names, lengths = batch.column(0).dictionary_encode(), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(3)), -1))
            place, counts, files = np.asarray(names.indices), np.asarray(batch.column(2)), batch.column(1)
            for width in np.unique(lengths[lengths >= 0]).tolist():
                rows = np.flatnonzero(lengths == width)
                z = matrix(batch.column(3).take(pa.array(rows)), width) if width else np.zeros((len(rows), 0))
                order = np.argsort(place[rows], kind="stable")
                rows, z, of = rows[order], z[order], place[rows][order]
                starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                total, n = np.add.reduceat(z, starts, axis=0), np.add.reduceat(counts[rows], starts)
                for i, lo in enumerate(starts.tolist()):
                    hi = starts[i + 1] if i + 1 < len(starts) else len(rows)
                    key, first = (names.dictionary[int(of[lo])].as_py(), width), pa.compute.min(files.take(pa.array(rows[lo:hi]))).as_py()
                    had = held.get(key)
                    held[key] = (first, int(n[i]), total[i]) if had is None else (min(first, had[0]), had[1] + int(n[i]), had[2] + total[i])
            if len(held) >= HELD:
                yield told(held)
                held = {}
        yield told(held)

    source = frames.filter(F.col(vector).isNotNull()).select(F.col(session).cast("string").alias("key"), F.coalesce(F.col(file).cast("string"), F.lit("")).alias("file"), F.lit(1).cast("long").alias("n"), F.col(vector).cast("array<double>").alias("sum"))
    text = "key string, file string, n long, sum array<double>"
    known = source.filter(F.col("key").isNotNull())
    sums = known.mapInArrow(summed, text).repartition("key").sortWithinPartitions("key").mapInArrow(summed, text)
    # a session that stands at a border of what a task held comes in parts of one task; they meet here without a shuffle
    first = sums.groupBy("key", F.size("sum").alias("_width")).agg(F.min("file").alias("file"), F.sum("n").alias("n"), F.collect_list("sum").alias("parts"))
    whole = first.withColumn("sum", F.reduce(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", 0), lambda a, b: F.zip_with(a, b, lambda u, v: u + v)))
    best = whole.groupBy("key").agg(F.min_by(F.struct("sum", "n"), F.col("file")).alias("_best"))
    return best.select(F.col("key").cast(frames.schema[session].dataType).alias(session), F.transform(F.col("_best")["sum"], lambda v: v / F.col("_best")["n"]).alias("mean"))


#: Columns up to which means are plain averages by column; numbers of all means that are broadcast; copies of a mean for a
#: join beyond that.
PLAIN_COLUMNS, BROADCAST_NUMBERS, SALT = 64, 4 << 20, 8


def _plain_means(frames: DataFrame, session: str, vector: str, file: str, width: int) -> DataFrame:
    """(session, mean), the same as `means` of vectors of up to width numbers: averages by column, no Python."""
    name = F.coalesce(F.col(file).cast("string"), F.lit(""))
    known = frames.filter(F.col(vector).isNotNull() & F.col(session).isNotNull()).select(F.col(session).alias("_s"), name.alias("_f"), F.col(vector).cast("array<double>").alias("_v"))
    sums = known.groupBy("_s", F.size("_v").alias("_n")).agg(F.min("_f").alias("_f"), *[F.avg(F.get("_v", i)).alias(f"_m{i}") for i in range(width)])
    mean = F.slice(F.array(*[F.col(f"_m{i}") for i in range(width)]).cast("array<double>"), F.lit(1), F.col("_n"))
    return sums.select("_s", "_f", mean.alias("_mean")).groupBy("_s").agg(F.min_by("_mean", "_f").alias("mean")).withColumnRenamed("_s", session)


def with_context(frames: DataFrame, session: str, vector: str, file: str = "file", source: DataFrame | None = None) -> DataFrame:
    """frames with context: the session's mean, or the frame's own vector where that is missing or differs in length.
    Means are broadcast while they are few; else they are joined on the session and a salt, so that a hot session is not
    one task. A vector with a null number raises. source: the same frames with less work behind them, to take means from."""
    source = frames if source is None else source
    facts = source.agg(F.max(F.size(vector)).alias("width"), F.count_distinct(session).alias("sessions"), F.coalesce(F.bool_or(F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x))), F.lit(False)).alias("holes")).first()
    if facts["holes"]:
        raise ValueError("a vector has a null or NaN number: leave such rows out, or fill them")
    width = max(facts["width"] or 0, 0)
    found = _plain_means(source, session, vector, file, width) if width <= PLAIN_COLUMNS else _summed_means(source, session, vector, file)
    of, mean, salt, own = fresh(frames, "_session", "_mean", "_salt", "_own")
    found = found.select(F.col(session).alias(of), F.col("mean").alias(mean))
    if facts["sessions"] * max(width, 1) <= BROADCAST_NUMBERS:
        joined = frames.join(F.broadcast(found), F.col(session) == F.col(of), "left")
    else:
        copies = found.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        salted = frames.withColumn(own, F.pmod(F.xxhash64(file, vector), F.lit(SALT)))
        joined = salted.join(copies, (F.col(session) == F.col(of)) & (F.col(own) == F.col(salt)), "left").drop(salt, own)
    fits = F.col(mean).isNotNull() & (F.size(mean) == F.size(vector))
    return joined.withColumn("context", F.when(fits, F.col(mean)).otherwise(F.col(vector))).drop(of, mean)


def levels(long: DataFrame, session: str, param: str, value: str) -> DataFrame:
    """long with level, the mean of its session and parameter, and residual. The means are partial sums, joined back with a
    salt unless they are few, so no task holds all rows of a session."""
    of, which, mean = fresh(long, "_session", "_param", "_mean")
    found = long.groupBy(F.col(session).alias(of), F.col(param).alias(which)).agg(F.avg(value).alias(mean))
    few = found.limit(BROADCAST_NUMBERS // 8 + 1).count() <= BROADCAST_NUMBERS // 8
    same = F.col(session).eqNullSafe(F.col(of)) & F.col(param).eqNullSafe(F.col(which))
    if few:
        joined = long.join(F.broadcast(found), same)
    else:
        salt, own = fresh(long, "_salt", "_own")
        copies = found.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        joined = long.withColumn(own, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in long.columns]), F.lit(SALT))).join(copies, same & (F.col(own) == F.col(salt))).drop(salt, own)
    return joined.withColumn("level", F.col(mean)).withColumn("residual", F.col(value) - F.col("level")).drop(of, which, mean)


def spreads(long: DataFrame, param: str, value: str) -> DataFrame:
    """(param, n, mean, spread, degenerate) with the population spread, floored."""
    s = F.stddev_pop(value)
    return long.groupBy(param).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.greatest(F.lit(LEAST_SPREAD), s).alias("spread"), (s < DEGENERATE).alias("degenerate"))


def beside(rows: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """rows with what facts (a row per value of on) say of theirs, as an inner join. Facts that are few are taken once and
    broadcast; more of them are joined with a salt, so that a value which most rows have is not one task."""
    few = facts.limit(FEW_FACTS + 1).collect()
    if len(few) <= FEW_FACTS:
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(few, facts.schema)), on)
    salt, own = fresh(rows, "_salt", "_own")
    copies = facts.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    salted = rows.withColumn(own, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALT))).alias("rows")
    met = salted.join(copies.alias("facts"), (F.col(f"rows.{on}") == F.col(f"facts.{on}")) & (F.col(own) == F.col(salt)))
    return met.select("rows.*", *[F.col(f"facts.`{c}`") for c in facts.columns if c != on]).drop(own)


def standardised(long: DataFrame, param: str, value: str) -> DataFrame:
    return beside(long, spreads(long, param, value), param).withColumn("z", (F.col(value) - F.col("mean")) / F.col("spread"))
