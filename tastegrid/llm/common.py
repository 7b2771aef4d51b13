"""What the training-data operators share: words, table access, the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, null: 0."""
    return F.size(words(text)).cast("long")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash48(*parts: Column | str) -> Column:
    """A number below 2**48 from the MD5 of the parts joined by colons; any SQL engine can repeat it."""
    cols = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 12), 16, 10).cast("long")


#: Bytes of text that a task turns into Python objects at once; one longer text is a part of its own.
PART_BYTES = 256 << 10


def parts(batch: pa.RecordBatch, column: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts in a column add up to about limit bytes, so that a task's memory depends
    on neither the session's batch settings nor how long its rows are."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encoded(column: pa.Array) -> list[bytes]:
    """Texts in UTF-8; a null text is empty."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return pa.compute.fill_null(raw, b"").to_pylist()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def released(run: Callable) -> Callable:
    """run, after which the worker, which lives on for other tasks, gives back what Arrow holds."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, and all
    tasks run in this process, a folder of our own; on a cluster it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
