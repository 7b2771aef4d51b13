"""Regression from moments: one pass collects sums by group, and every fit after that is small algebra.

The sums of a group are additive, so the moments of all rows but a fold's are the total less the fold's: one
Spark job serves every fold, penalty and target. Sums are shifted by a common centre to keep their precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a row, and bytes of all groups' moments: what a task holds and what is brought to the driver.
MAX_COLUMNS, MAX_BYTES = 1_000, 256 << 20
#: Rows that the common centre is taken from; any centre gives the same fits, a near one keeps digits.
CENTRE_ROWS = 1_000
FLOOR = 1e-12
#: Numbers from which on a block is passed on, and such blocks that a task holds.
BLOCK_NUMBERS, HELD_BLOCKS = 1 << 17, 16
#: Rows that many models score at once.
SCORED_ROWS = 1 << 9
BLOCKS = pa.schema([("key", pa.string()), ("block", pa.binary())])
#: A column's spread counts as this at least.
LEAST_SPREAD = 1e-6


@dataclass
class Moments:
    """n rows, total weight, and weighted sums of z z' for z = (1, x - centre, y - centre)."""

    n: int
    gram: np.ndarray
    centre: np.ndarray
    dim: int

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.gram - other.gram, self.centre, self.dim)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.gram + other.gram, self.centre, self.dim)

    @property
    def weight(self) -> float:
        return float(self.gram[0, 0])

    @property
    def mean(self) -> np.ndarray:
        return self.centre + self.gram[0, 1:] / max(self.weight, FLOOR)

    @property
    def covariance(self) -> np.ndarray:
        """Weighted scatter of (x, y) about their means: sums, not averages."""
        s = self.gram[0, 1:]
        return self.gram[1:, 1:] - np.outer(s, s) / max(self.weight, FLOOR)


    def picked(self, x: slice, y: slice) -> Moments:
        """The moments of some of the columns, places in x and in y."""
        at = np.concatenate((np.arange(self.dim)[x], self.dim + np.arange(len(self.centre) - self.dim)[y]))
        rows = np.concatenate(([0], at + 1))
        return Moments(self.n, self.gram[np.ix_(rows, rows)], self.centre[at], len(np.arange(self.dim)[x]))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists as rows of numbers; lists of another length and null or NaN numbers raise."""
    flat = column.flatten()
    if len(flat) != len(column) * width or (len(column) and pa.compute.min(pa.compute.list_value_length(column)).as_py() != width):
        raise ValueError(f"a vector has not {width} numbers")
    out = np.asarray(flat.cast(pa.float64()), dtype=float).reshape(-1, width)
    if np.isnan(out).any():
        raise ValueError("a vector has a null or NaN number: leave such rows out, or fill them")
    return out


def by_key(column: pa.Array) -> list[tuple[str, np.ndarray]]:
    """The keys of an Arrow column, each with the places of its rows in order; nulls have no key."""
    codes = column.cast(pa.string()).dictionary_encode()
    place = np.asarray(pa.compute.fill_null(codes.indices, -1))
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(len(codes.dictionary) + 1))
    return [(key, order[lo:hi]) for key, lo, hi in zip(codes.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True)]


def _summed(partial: DataFrame) -> dict[str, tuple[int, np.ndarray]]:
    """What tasks have summed (key, n, sums), summed by key after a shuffle."""

    def added(batches):
        held: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for key, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = held.get(key, (0, 0.0))
                held[key] = (before[0] + n, before[1] + np.frombuffer(raw))
        yield _told(held)

    return {r["key"]: (r["n"], np.frombuffer(r["sums"])) for r in partial.repartition("key").mapInArrow(added, SUMS).collect()}


SUMS = "key string, n long, sums binary"


def _told(held: dict) -> pa.RecordBatch:
    kind = pa.schema([("key", pa.string()), ("n", pa.int64()), ("sums", pa.binary())])
    return pa.RecordBatch.from_pydict({"key": list(held), "n": [n for n, _ in held.values()], "sums": [v.tobytes() for _, v in held.values()]}, schema=kind)


def sums_by_key(rows: DataFrame, width: int, add: Callable[[object, np.ndarray, np.ndarray], np.ndarray]) -> dict[str, tuple[int, np.ndarray]]:
    """rows (key, z, w): per key the row count and what add makes of its rows, summed. Each task keeps one array a key
    that it meets; keys meet again after a shuffle of these."""

    def partial(batches):
        held: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            z, w = matrix(batch.column(1), width), np.asarray(batch.column(2), dtype=float)
            for key, at in by_key(batch.column(0)):
                n, sums = held.get(key, (0, 0.0))
                held[key] = (n + len(at), sums + add(key, z[at], w[at]))
        yield _told(held)

    return _summed(rows.mapInArrow(partial, SUMS))


def packed(rows: DataFrame, width: int) -> DataFrame:
    """rows (key, z) as (key, block): the numbers of some rows of a key, as bytes. What goes over rows more than once
    holds these, so lists are made and read only once. A task holds at most HELD_BLOCKS blocks' numbers."""

    def told(held: dict, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": keys, "block": [b"".join(held.pop(key)) for key in keys]}, schema=BLOCKS)

    def blocks(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            z = matrix(batch.column(1), width)
            for key, at in by_key(batch.column(0)):
                held.setdefault(key, []).append(z[at].tobytes())
                sizes[key] = sizes.get(key, 0) + len(at) * width
            full = list(held) if sum(sizes.values()) > HELD_BLOCKS * BLOCK_NUMBERS else [key for key, n in sizes.items() if n >= BLOCK_NUMBERS]
            if full:
                yield told(held, full)
                sizes = {key: n for key, n in sizes.items() if key in held}
        yield told(held, list(held))

    return rows.mapInArrow(blocks, "key string, block binary")


def unpacked(batch: pa.RecordBatch, width: int):
    """(key, rows of numbers) of the blocks of a batch."""
    for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield key, np.frombuffer(block.as_buffer()).reshape(-1, width)


def sums_of_blocks(blocks: DataFrame, width: int, add: Callable[[str, np.ndarray, np.ndarray], np.ndarray]) -> dict[str, tuple[int, np.ndarray]]:
    """The same as sums_by_key, of packed rows that weigh 1."""

    def partial(batches):
        held: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for key, z in unpacked(batch, width):
                n, sums = held.get(key, (0, 0.0))
                held[key] = (n + len(z), sums + add(key, z, np.ones(len(z))))
        yield _told(held)

    return _summed(blocks.mapInArrow(partial, SUMS))


def products(centre: np.ndarray) -> Callable[[object, np.ndarray, np.ndarray], np.ndarray]:
    """Weighted sums of z z' for z = (1, row - centre)."""

    def add(key: object, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        one = np.column_stack((np.ones(len(z)), z - centre))
        return ((one * w[:, None]).T @ one).ravel()

    return add


def collect(df: DataFrame, x: str, y: str, group: str, weight: str | None = None) -> dict[str, Moments]:
    """Moments by group of array columns x and y."""
    first = df.select(F.concat(x, y).alias("z"), F.size(x).alias("d")).limit(CENTRE_ROWS).collect()
    if not first:
        return {}
    d, width = first[0]["d"], len(first[0]["z"])
    centre = np.nan_to_num(np.array([r["z"] for r in first if len(r["z"]) == width], dtype=float).mean(axis=0))
    side = len(centre) + 1
    groups = df.select(group).distinct().count()
    if side - 1 > MAX_COLUMNS or groups * side * side * 8 > MAX_BYTES:
        raise ValueError(f"at most {MAX_COLUMNS} columns, and {MAX_BYTES} bytes of moments: {groups} groups of {side} by {side} are more")

    rows = df.select(F.col(group), F.concat(x, y).alias("_z"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    return {key: Moments(n, gram.reshape(side, side).copy(), centre, d) for key, (n, gram) in sums_by_key(rows, side - 1, products(centre)).items()}


def errors(df: DataFrame, x: str, truth: str, models: dict[str, tuple[np.ndarray, np.ndarray]], group: str) -> dict[str, tuple[int, np.ndarray]]:
    """Per group the row count and the sums of absolute errors of its models, in one pass. models: group ->
    (coefficients, intercepts), a column a model; they score the targets of truth in turn."""
    d = len(next(iter(models.values()))[0])
    width = d + len(df.select(truth).limit(1).collect()[0][0])
    shared = df.sparkSession.sparkContext.broadcast(models)

    def off(key: object, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        b, c = shared.value[key]
        said = (z[:, :d] @ b + c).reshape(len(z), -1, width - d)
        return np.abs(said - z[:, None, d:]).sum(axis=0).ravel()

    return sums_by_key(df.select(F.col(group), F.concat(x, truth).alias("_z"), F.lit(1.0).alias("_w")), width, off)


def errors_of_blocks(blocks: DataFrame, d: int, t: int, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[int, np.ndarray]]:
    """The same as errors, of packed rows of d columns and t targets. A few rows are scored at once, so that the answers of
    many models stay near the processor."""
    shared = blocks.sparkSession.sparkContext.broadcast(models)

    def off(key: str, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        b, c = shared.value[key]
        out = np.zeros(b.shape[1])
        truth = np.tile(np.arange(d, d + t), b.shape[1] // t)
        for at in range(0, len(z), SCORED_ROWS):
            part = z[at : at + SCORED_ROWS]
            missed = part[:, :d] @ b
            missed += c
            missed -= part[:, truth]
            out += np.abs(missed, out=missed).sum(axis=0)
        return out

    return sums_of_blocks(blocks, d + t, off)


def total(parts: dict[object, Moments]) -> Moments:
    found = list(parts.values())
    out = found[0]
    for p in found[1:]:
        out = out + p
    return out


def ridge(m: Moments, penalty: float, per_weight: bool, standardised: bool = False, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts), a column a target. The penalty adds to the scatter as it is, or times the total
    weight; standardised: to that of columns over their spreads. A column that is not allowed has no part."""
    s = m.covariance[: m.dim, :]
    scale = np.maximum(np.sqrt(np.maximum(np.diag(s), 0) / max(m.weight, FLOOR)), LEAST_SPREAD) if standardised else np.ones(m.dim)
    if allowed is not None:
        scale = np.where(allowed, scale, np.inf)
    a = s[:, : m.dim] / scale / scale[:, None] + np.eye(m.dim) * max(penalty * (m.weight if per_weight else 1.0), FLOOR)
    b = np.linalg.solve(a, s[:, m.dim :] / scale[:, None]) / scale[:, None]
    return b, m.mean[m.dim :] - m.mean[: m.dim] @ b


def principal(m: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading axes of x and their shares of the variance; each axis has its largest part positive."""
    values, axes = np.linalg.eigh(m.covariance[: m.dim, : m.dim])
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    return axes, values / max(float(np.trace(m.covariance[: m.dim, : m.dim])), FLOOR)
