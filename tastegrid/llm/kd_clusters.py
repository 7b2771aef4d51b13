"""k-means on integer vectors, exact, by filtering centroids through kd-trees.

Each component x becomes floor(scale * x). Every task builds kd-trees of up to BLOCK of its vectors; a node holds its
count, the integer sum of its vectors and their box. The trees are written once. A round walks every tree from its root
with all centroids: a centroid that at every corner of the box is farther than the one nearest the box's middle is
dropped (strictly, so ties stay), a node with one centroid left gives it its count and sum whole, and a leaf compares
its vectors with those that are left. What tasks add up, a count and a sum a centroid, is summed by key; centroids are a
bounded number of integers, go to the tasks with the round and come back as sums, so no round shuffles a vector.

All arithmetic is in integers, or in doubles where every number is an integer that they hold exactly.

Cases: vectors that are null, of another length, or with null or non-finite components are left out; equal vectors are
all kept, and a vector with a null id is clustered like others (its hash is that of no id); of vectors with equal ids
the lesser is the earlier start; fewer vectors than centroids give fewer centroids; an empty table gives an empty
result; columns other than id and vector are left out. Components whose integer reaches the bound of `most` raise, as
distances would no longer fit 64 bits (262,144 at 64 components and a scale of 256).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .common import released, written

#: Vectors in one tree and in a leaf that is not split, and integers that all centroids may have together.
BLOCK, LEAF = 4096, 64
MAX_NUMBERS = 1 << 20
#: Doubles hold integers below this exactly.
EXACT = 1 << 53


def most(components: int) -> int:
    """The bound of a component's integer: what a walk adds up stays below 2**62."""
    return int((2**62 / components) ** 0.5) >> 2


@dataclass
class Tree:
    """Nodes in preorder: the left child is the next node, `right` is 0 in a leaf; `points` are in order of leaves."""

    points: np.ndarray
    first: list[int]
    last: list[int]
    right: list[int]
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray | int]]:
        """Nodes that cover all vectors, each with its one centroid or with a centroid for each of its vectors."""
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            i, left = stack.pop()
            left = self._undominated(i, centroids, left)
            if len(left) == 1:
                yield i, int(left[0])
            elif self.right[i]:
                stack += [(self.right[i], left), (i + 1, left)]
            else:
                yield i, left[nearest(self.points[self.first[i] : self.last[i]], centroids[left])]

    def _undominated(self, i: int, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
        if len(left) == 1:
            return left
        low, high, c = self.low[i], self.high[i], centroids[left]
        near = c[np.square(2 * c - (low + high)).sum(axis=1).argmin()]
        step = c - near
        corner = np.where(step > 0, high, low)
        return left[(step * (c + near - 2 * corner)).sum(axis=1) <= 0]


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each point's nearest centroid, the smallest of equals."""
    size = 4 * points.shape[1] * max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max())) ** 2
    kind = np.float64 if size < EXACT else np.int64
    c = centroids.astype(kind)
    return (np.square(c).sum(axis=1) - 2 * (points.astype(kind) @ c.T)).argmin(axis=1)


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The order of the points in the tree, and the tree. Boxes are split at the median of their longest side."""
    order = np.arange(len(points))
    first, last, right, low, high, sums = [], [], [], [], [], []
    stack = [(0, len(points), -1)]
    while stack:
        lo, hi, parent = stack.pop()
        me = len(first)
        if parent >= 0:
            right[parent] = me
        part = points[order[lo:hi]]
        a, b = part.min(axis=0), part.max(axis=0)
        for column, value in zip((first, last, right, low, high, sums), (lo, hi, 0, a, b, part.sum(axis=0)), strict=True):
            column.append(value)
        side = int((b - a).argmax())
        if hi - lo > leaf and a[side] < b[side]:
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, side], mid)]
            stack += [(lo + mid, hi, me), (lo, lo + mid, -1)]
    return order, Tree(points[order].astype(np.int32), first, last, right, np.array(low), np.array(high), np.array(sums))


def usable(vector: Column, components: int) -> Column:
    """Whether a vector has this many components, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def integers(values: np.ndarray, components: int, scale: int) -> np.ndarray:
    out = np.floor(values.astype(np.float64).reshape(-1, components) * scale)
    if np.abs(out).max(initial=0) >= most(components):
        raise ValueError(f"a component of {np.abs(out).max() / scale:g} is too large for exact distances")
    return out.astype(np.int64)


def trees(vectors: DataFrame, components: int, scale: int, block: int = BLOCK) -> DataFrame:
    """Of rows (id, vector): a row per kd-tree with the ids in the order of its points."""
    kind = vectors.schema[0].dataType

    def run(batches):
        ids, held, n = [], [], 0

        def tree():
            order, made = build(np.concatenate(held))
            owner = pa.chunked_array(ids).combine_chunks().take(pa.array(order))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), owner), pa.array([pickle.dumps(made)], pa.binary())], names=["ids", "tree"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n)
                ids.append(part.column(0))
                held.append(integers(part.column(1).flatten().to_numpy(zero_copy_only=False), components, scale))
                at, n = at + part.num_rows, n + part.num_rows
                if n == block:
                    yield tree()
                    ids, held, n = [], [], 0
        if n:
            yield tree()

    return vectors.mapInArrow(released(run), StructType().add("ids", ArrayType(kind)).add("tree", BinaryType()))


def starts(vectors: DataFrame, clusters: int, components: int, scale: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the least hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("h"), F.col("vector").alias("v")).orderBy("h", "v").limit(clusters).collect()
    return integers(np.array([r["v"] for r in rows], dtype=np.float64), components, scale)


def moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors, or as they were where they have none."""

    def run(batches):
        total = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                tree = pickle.loads(raw.as_py())
                for i, found in tree.walk(centroids):
                    if isinstance(found, int):
                        total[found, 0] += tree.last[i] - tree.first[i]
                        total[found, 1:] += tree.sums[i]
                    else:
                        np.add.at(total[:, 0], found, 1)
                        np.add.at(total[:, 1:], found, tree.points[tree.first[i] : tree.last[i]])
        cluster, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[cluster, at])], names=["cluster", "at", "total"])

    sums = held.select("tree").mapInArrow(released(run), "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    total = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=np.int64)
    for r in sums.collect():
        total[r["cluster"], r["at"]] = r["total"]
    filled = total[:, 0] > 0
    out = centroids.copy()
    out[filled] = total[filled, 1:] // total[filled, :1]
    return out


def assigned(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row per vector: its id, cluster and squared distance."""

    def run(batches):
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1), strict=True):
                tree = pickle.loads(raw.as_py())
                cluster = np.empty(len(tree.points), dtype=np.int32)
                for i, found in tree.walk(centroids):
                    cluster[tree.first[i] : tree.last[i]] = found
                distance = np.square(tree.points.astype(np.int64) - centroids[cluster]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    kind = held.schema["ids"].dataType.elementType
    return held.select("ids", "tree").mapInArrow(released(run), StructType().add("id", kind).add("cluster", IntegerType()).add("distance", LongType()))


def clustered(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, clusters: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    if clusters * components > MAX_NUMBERS:
        raise ValueError(f"{clusters} centroids of {components} components are more than {MAX_NUMBERS} numbers")
    own = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector")).filter(usable(F.col("vector"), components))
    centroids = starts(own, clusters, components, scale, seed)
    spark, added = vectors.sparkSession, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    held = written(trees(own, components, scale), "kd-trees")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(held, centroids)
    rows = written(assigned(held, centroids), "clustered")
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of_cluster = [(k, v, sum(inertia.values()), digest(centroids[k])) for k, v in sorted(inertia.items())]
    return rows.join(F.broadcast(spark.createDataFrame(of_cluster, added)), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
