"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets share the words of the whole corpus by weight; a source that would need more than max_repeats passes
over its words stops there and the excess is shared again among the others by weight. Each source's words are
laid out in one permuted order (by hash), pass after pass, and cut into blocks. The exact block quotas of all
sources are then split among the output shards: at each node of a binary tree the left half draws its share of the
blocks that the node holds without replacement, the blocks with the least hash at that node, so the counts by source
are one multivariate-hypergeometric draw. All shards have equal totals and quotas stay exact; no block is drawn
twice. A shard takes a run of each source's permuted blocks and is shuffled locally. Blocks grow with the corpus, so
that there are at most MAX_BLOCKS and one more a source: the tree's work is bounded at any size.

Cases: a null source is a source of its own, last in order; a null or empty text has size 0 and is never taken;
a corpus without words has target 0 everywhere; a very long text is one row of many blocks, its copies belong to the
shard of the block in which they begin; repeated rows count each time; equal hashes fall back to doc_id; an empty
table gives an empty result; extra columns pass through, whatever their names, but columns that carry an output name
(source_size, target, taken, copies; copy, words, block, shard of the drawn rows) are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType
from pyspark.sql.window import Window

from .common import fresh, hash48, n_words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
N_SHARDS = 16
BLOCK_WORDS = 4096
#: Most blocks that all sources have together, but for one of each that is not full.
MAX_BLOCKS = 1 << 18
#: Rows of one permutation bucket, the most that one window task sorts together.
BUCKET_ROWS = 1_000
#: A mixture names its sources: their quotas, a row each, are split on the driver.
MAX_SOURCES = 100_000


def source_targets(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per source: source, n_rows, source_size, weight, target.

    target = min(cap, level * weight) with cap = max_repeats * source_size. The level is the one at which the
    targets add up to the whole corpus: in the order of cap / weight, the first source that (what is left after
    the caps before it) / (the weights from it on) does not exceed.
    """
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    rows = sums.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    # from here on a local table of a bounded number of rows
    sums = docs.sparkSession.createDataFrame(rows, sums.schema)
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("_rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    caps = ranked.withColumn("_cap", F.col("source_size") * max_repeats).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    tried = caps.withColumn("_level", level)
    found = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"]
    return tried.withColumn("target", F.coalesce(F.least(F.col("_cap").cast("double"), found * F.col("weight")), F.lit(0.0))).select("source", "n_rows", "source_size", "weight", "target")


def split_quotas(quotas: np.ndarray, n_shards: int) -> np.ndarray:
    """quotas: blocks by source. Gives (n_shards, n_sources): every column adds up to its quota, row totals
    differ by one at most. At each node the left half draws its blocks without replacement from what the node holds:
    those with the least hash of node, source and block."""
    quotas = np.asarray(quotas, dtype=np.int64)
    total = int(quotas.sum())
    room = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], dtype=np.int64)
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    source = np.repeat(np.arange(len(quotas)), quotas)
    number = np.arange(total) - np.repeat(np.cumsum(quotas) - quotas, quotas)

    def split(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = np.bincount(source[held], minlength=len(quotas))
            return
        mid = (lo + hi) // 2
        draw = [int(hashlib.md5(f"{lo}-{hi}:{s}:{b}".encode()).hexdigest()[:12], 16) for s, b in zip(source[held].tolist(), number[held].tolist(), strict=True)]
        order = held[np.lexsort((held, np.array(draw, dtype=np.int64)))]
        left = int(room[lo:mid].sum())
        split(lo, mid, np.sort(order[:left]))
        split(mid, hi, np.sort(order[left:]))

    split(0, n_shards, np.arange(total))
    return out


def _plan(spark: SparkSession, targets: DataFrame, n_shards: int, block_words: int) -> DataFrame:
    """A row per source: words to take, passes, block length, and the first block of each shard's run."""
    rows = targets.collect()
    rows.sort(key=lambda r: (r["source"] is None, str(r["source"] or "").encode()))
    take = np.array([int(np.floor(r["target"] + 0.5)) for r in rows], dtype=np.int64)
    block = max(block_words, int(take.sum()) // MAX_BLOCKS + 1)
    quotas = -(-take // block)
    shares = split_quotas(quotas, n_shards) if len(rows) else np.zeros((n_shards, 0), dtype=np.int64)
    firsts = np.cumsum(shares, axis=0) - shares
    plan = [
        (r["source"], r["source_size"], float(r["target"]), int(t), int(t // r["source_size"]) if r["source_size"] else 0, block, max(1, -(-r["n_rows"] // BUCKET_ROWS)), [int(x) for x in firsts[:, i]])
        for i, (r, t) in enumerate(zip(rows, take, strict=True))
    ]
    schema = StructType().add("source", targets.schema["source"].dataType).add("source_size", LongType()).add("target", DoubleType())
    for name in ("take", "passes", "length", "buckets"):
        schema = schema.add(name, LongType())
    return spark.createDataFrame(plan, schema.add("firsts", ArrayType(LongType())))


def _copies(size: Column, plan: Column, before: Column, cut: str, max_repeats: int) -> Column:
    """The copies of a document that the mix takes: copy, words, block, shard. plan: its source's row of the plan."""
    passes, rest = plan["passes"], plan["take"] - plan["passes"] * plan["source_size"] - before
    extra = F.greatest(F.lit(0), F.least(rest, size))
    if cut == "whole":
        extra = F.when(extra * 2 >= size, size).otherwise(F.lit(0))
    every = F.transform(F.sequence(F.lit(0), F.lit(max_repeats)), lambda c: F.struct(c.alias("copy"), F.when(c < passes, size).when(c == passes, extra).otherwise(F.lit(0)).cast("long").alias("words")))
    block = lambda c: F.floor((c * plan["source_size"] + before) / plan["length"])
    shard = lambda c: F.size(F.filter(plan["firsts"], lambda f: f <= block(c))) - 1
    taken = F.filter(every, lambda x: x["words"] > 0)
    return F.transform(taken, lambda x: F.struct(x["copy"].alias("copy"), x["words"].alias("words"), block(x["copy"]).alias("block"), shard(x["copy"]).alias("shard")))


def mix(docs: DataFrame, *, weights=WEIGHTS, n_shards: int = N_SHARDS, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS, cut: str = "words") -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target, taken and copies.

    taken: words the mix takes, repeats counted. copies: the copies taken, with their block and output shard.
    cut="words" cuts a source's last copy where its target is met; "whole" takes or leaves that copy whole,
    whichever is nearer. docs is read three times: give a stored table where size is costly.
    """
    kept = [c for c in docs.columns if c not in ("source_size", "target", "taken", "copies")]
    docs = docs.select(*[f"`{c}`" for c in kept])
    targets = source_targets(docs.select("source", "size"), weights, max_repeats)
    plan = _plan(docs.sparkSession, targets, n_shards, block_words)
    name, order, bucket, of, head, within = fresh(docs, "_plan", "_order", "_bucket", "_of", "_head", "_within")
    plan = plan.select(F.col("source").alias(of), F.struct(*plan.columns).alias(name))
    # at most MAX_SOURCES rows, so the plan is broadcast and no source's rows meet for it
    planned = docs.withColumn(order, hash48(F.col("doc_id"), "mix")).join(F.broadcast(plan), F.col("source").eqNullSafe(F.col(of)), "inner").drop(of)
    planned = planned.withColumn(bucket, F.floor(F.col(order) / F.lit(float(2**48)) * F.col(name)["buckets"]))
    sums = planned.groupBy("source", bucket).agg(F.first(name).alias(name), F.sum("size").alias(within))
    earlier = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # a bucket's words before it go in as its first row, so that rows are shuffled once and joined with nothing
    heads = sums.select("source", bucket, name, F.coalesce(F.sum(within).over(earlier), F.lit(0)).cast(docs.schema["size"].dataType).alias("size"), F.lit(-1).cast("long").alias(order), F.lit(True).alias(head))
    run = Window.partitionBy("source", bucket).orderBy(order, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    both = planned.withColumn(head, F.lit(False)).unionByName(heads, allowMissingColumns=True)
    placed = both.withColumn(within, F.coalesce(F.sum("size").over(run), F.lit(0))).filter(~F.col(head))
    copies = _copies(F.col("size"), F.col(name), F.col(within), cut, max_repeats)
    out = placed.withColumn("copies", copies).withColumns({"source_size": F.col(name)["source_size"], "target": F.col(name)["target"]})
    out = out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    return out.select(*[f"`{c}`" for c in kept], "source_size", "target", "taken", "copies")


def drawn(mixed: DataFrame) -> DataFrame:
    """A row per copy that the mix takes, with copy, words, block and shard."""
    rest = [f"`{c}`" for c in mixed.columns if c not in ("copies", "copy", "words", "block", "shard")]
    return mixed.select(*rest, F.inline("copies"))


def shuffled(mixed: DataFrame, seed: int = 20_240) -> DataFrame:
    """The drawn copies by shard, each shard in a random order of its own: partitions are even ranges of shard and a
    hash of the copy, so a shard is a run of partitions, as many as its rows need."""
    out = drawn(mixed)
    (order,) = fresh(out, "_order")
    out = out.withColumn(order, F.xxhash64("doc_id", "copy", F.lit(seed)))
    return out.repartitionByRange("shard", order).sortWithinPartitions("shard", order).drop(order)


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", n_words(F.col("text")))
