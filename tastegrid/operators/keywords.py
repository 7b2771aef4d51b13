"""Keywords of frames: the terms of a vocabulary whose vectors lie nearest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from .moments import matrix

#: Terms of a vocabulary, which goes to every task.
MAX_TERMS = 100_000
#: Rows that meet the whole vocabulary at once.
ROWS = 512


def top(frames: DataFrame, vocabulary: DataFrame, id: str, vector: str, *, k: int = 6, floor: float = 0.2) -> DataFrame:
    """(id, rank, label, score): of each frame's k best terms those at the floor or above: limit, then filter. Scores
    count to six places; of equal ones the lesser term goes first. vocabulary (term, vector) has at most MAX_TERMS."""
    terms = vocabulary.select(F.col("term").cast("string").alias("term"), F.col("vector").cast("array<double>").alias("vector")).orderBy("term").limit(MAX_TERMS + 1).collect()
    if len(terms) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    names = [r["term"] for r in terms]
    shared = frames.sparkSession.sparkContext.broadcast(np.array([r["vector"] for r in terms], dtype=float).reshape(len(names), -1) if names else np.zeros((0, 0)))
    kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))
    type_ = ArrayType(StructType().add("label", StringType()).add("score", DoubleType()))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                found = [[] for _ in range(part.num_rows)]
                if names:
                    places = np.floor(matrix(part.column(1), shared.value.shape[1]) @ shared.value.T * 1e6 + 0.5).astype(np.int64)
                    # terms are in order, so the place breaks ties
                    order = places * len(names) + np.arange(len(names) - 1, -1, -1)
                    best = -np.sort(-np.partition(order, max(0, len(names) - k), axis=1)[:, -k:], axis=1)
                    found = [[{"label": names[len(names) - 1 - int(o % len(names))], "score": float(o // len(names)) / 1e6} for o in row] for row in best]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=[id, "found"])

    rows = frames.select(id, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, StructType().add(frames.schema[id]).add("found", type_))
    placed = rows.select(id, F.posexplode("found").alias("rank", "f"))
    return placed.select(id, (F.col("rank") + 1).cast("int").alias("rank"), F.col("f")["label"].alias("label"), F.col("f")["score"].alias("score")).filter(F.col("score") >= floor)
