"""A function over Arrow batches that may fail on some rows: they are told, the others get their results.

A batch that fails is halved, and its halves again, down to single rows; a row that fails so many times by itself is a
poison row. A function runs at most about twice a row and level of halving, so a batch with one poison row costs its
logarithm in runs. Rows keep their order; what a task holds is one batch and its results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Times that a single row is tried, and rows that a function is given at once.
ATTEMPTS, BATCH_ROWS = 2, 1000

Function = Callable[[pa.RecordBatch], pa.RecordBatch]


def mapped(df: DataFrame, function: Function, schema: StructType, *, attempts: int = ATTEMPTS, error: str = "error", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df with the function's columns (of the schema) and error: null, or what the row failed with, and then the columns
    are null. The function must give a row for each row; one that does not has failed."""
    taken = {f.name.lower() for f in df.schema.fields}
    if clash := [n for n in (*schema.fieldNames(), error) if n.lower() in taken]:
        raise ValueError(f"df has columns {clash} already")
    made = to_arrow_schema(schema)
    whole = StructType([*df.schema.fields, *schema.fields]).add(error, "string")

    def tried(batch: pa.RecordBatch, left: int) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, str | None]]:
        try:
            out = function(batch)
            if out.num_rows != batch.num_rows:
                raise ValueError(f"{out.num_rows} rows for {batch.num_rows}")
            yield batch, pa.RecordBatch.from_arrays([out.column(n).cast(made.field(n).type) for n in made.names], schema=made), None
        except Exception as failed:
            if batch.num_rows > 1:
                half = batch.num_rows // 2
                yield from tried(batch.slice(0, half), attempts)
                yield from tried(batch.slice(half), attempts)
            elif left > 1:
                yield from tried(batch, left - 1)
            else:
                yield batch, None, f"{type(failed).__name__}: {failed}"

    def run(batches):
        for big in batches:
            for lo in range(0, big.num_rows, batch_rows):
                for rows, out, said in tried(big.slice(lo, batch_rows), attempts):
                    n = rows.num_rows
                    columns = out.columns if out is not None else [pa.nulls(n, t) for t in made.types]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *columns, pa.array([said] * n, pa.string())], names=whole.names)

    return df.mapInArrow(run, whole)
