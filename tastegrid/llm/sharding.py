"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child makes a weighted draw, -ln(u) / weight with u
hashed from the row's key and the child's name; the smallest draw wins, so a child gets its weight's share of
the rows. When a weight changes, only rows whose winner at that node changes move: into the subtree whose
weight grew, or out of the one whose weight shrank.

Cases: a null key hashes as the empty string; rows with equal keys land in one shard; an empty table gives an
empty result; a very long text is one row, of which its size and checksum are taken; a node whose weight is 0 is never drawn. In `shard_rows` and
`with_slots` extra columns pass through, but those named as an output are replaced; `sharded_documents` leaves them out.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, hash48


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


RACKS, PER_RACK = 2, 4


def even_tree(n_shards: int, racks: int = RACKS, per_rack: int = PER_RACK) -> list[Leaf]:
    """Shards 0 to n_shards - 1 in order: per_rack to a rack, racks to a region. A shard that opens a new
    region shares no subtree with the others, so it takes rows only into itself."""
    per_region = racks * per_rack
    return [Leaf(f"g{s // per_region}", f"g{s // per_region}/k{s // per_rack % racks}", s) for s in range(n_shards)]


def _level(leaves: list[Leaf], parent, child) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for leaf in leaves:
        if leaf.weight > 0:
            out[parent(leaf)][child(leaf)] += leaf.weight
    return out


def _draw(key: Column, children: Column) -> Column:
    """The name of the child with the smallest weighted draw, ties to the lesser name."""
    u = lambda c: (hash48(key, c["name"]) + 1) / F.lit(float(2**48 + 1))
    draws = F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(draws)["name"]


def _children(names: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(names.items())])


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: three draws, one a level; each sees only the children of the node above."""
    regions = _level(leaves, lambda x: "", lambda x: x.region)[""]
    if not regions:
        raise ValueError("the tree has no shard with a weight")
    racks = _level(leaves, lambda x: x.region, lambda x: x.rack)
    shards = _level(leaves, lambda x: x.rack, lambda x: f"s{x.shard}")
    below = lambda nodes: F.create_map(*[c for n, names in sorted(nodes.items()) for c in (F.lit(n), _children(names))])
    region = _draw(key, _children(regions))
    rack = _draw(key, F.element_at(below(racks), region))
    return F.substring(_draw(key, F.element_at(below(shards), rack)), 2, 12).cast("int")


#: Hash buckets of a shard: at least, at most, and rows of the table for each more.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 256, 16_384, 2_000_000


def with_slots(df: DataFrame, shard: str, key: str, buckets: int | None = None) -> DataFrame:
    """Adds slot, gapless from 0 within each shard. Rows are numbered within (shard, hash bucket) and moved up by
    the counts of the buckets before, so no shard is sorted in one task; the offsets are shards x buckets rows.
    Buckets grow with the table, of which they are a 2,000,000th, within bounds."""
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, df.count() // BUCKET_ROWS))
    bucket, of, at, n, offset = fresh(df, "_bucket", "_s", "_b", "_n", "_offset")
    bucketed = df.withColumn(bucket, (hash48(F.col(key), "slot") / F.lit(float(2**48)) * buckets).cast("int"))
    before = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(F.col(shard).alias(of), F.col(bucket).alias(at)).agg(F.count(F.lit(1)).alias(n))
        .select(of, at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    )
    order = Window.partitionBy(shard, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in df.columns if c != shard])
    joined = bucketed.join(F.broadcast(offsets), (F.col(shard) == F.col(of)) & (F.col(bucket) == F.col(at)))
    return joined.withColumn("slot", (F.col(offset) + F.row_number().over(order) - 1).cast("long")).drop(bucket, of, at, offset)


def shard_rows(df: DataFrame, key: str, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """df with shard and, where a grown tree is given, grown_shard: where each row lives after the change."""
    out = df.withColumn("shard", descend(F.col(key), leaves))
    return out.withColumn("grown_shard", descend(F.col(key), grown) if grown else F.lit(None).cast("int"))


def sharded_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """One row per document: its size, checksum, shard, slot, and the shard it has with one shard more. The law, one
    more shard takes rows only into itself, holds where that shard opens a region: for full regions of shards."""
    if n_shards % (RACKS * PER_RACK):
        raise ValueError(f"the law key needs a multiple of {RACKS * PER_RACK} shards, not {n_shards}")
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard_rows(light, "doc_id", even_tree(n_shards), even_tree(n_shards + 1))
    return with_slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
