"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links make.

A document is the set of its hashed word n-grams. Equal sets are one class and one node. Every set is ordered
from rare to frequent tokens, as a table of fixed size counts them over all documents, and by hash; any one order
gives the same links, this one keeps passages that many documents share out of the prefixes. Two sets with a similarity of at least t share a token in their prefixes of n - ceil(t * n) + 1 tokens, and
at least m in prefixes that are m - 1 tokens longer. Nodes that share a prefix token belong to the family of the
token's least node, and candidates are sought within families. The more partners a node's families hold, the
longer its prefix and the more prefix tokens it must share: a pair must share the lesser of its two demands. A
node of few partners, whose prefix is the plain one, sends only the tokens of it that another node's plain prefix
has; where it meets a longer prefix, both are bounded by their plain prefixes.

A family is cut into blocks by length (similar sets lie in one or two neighbouring length classes) and hash, of
about BLOCK nodes, and every pair of blocks is a group of its own: no group grows with its family. A pair of
blocks is first held against what its nodes can share at most, by sizes and numbers of shared tokens alone; then
it counts shared tokens by a matrix product, over prefixes, which leaves few nodes, and over the whole sets of
these, recomputed from their texts. It gives the links that join its nodes, not all pairs.

Cases: a null or empty text, or one without words, has the empty set and is linked with nothing; fewer words
than n are one shingle; a very long text is hashed in pieces, and long sets make blocks of fewer nodes, so that
neither a long text nor a long word needs more than a few times its own size; rows that share a doc_id are one node of the groups; rows with a null doc_id get a null
component; ties do not arise, as every pair at or above t is a link; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, fresh, parts, released, written
from .components import components
from .shingles import shingle_sets

#: Nodes and tokens of a block, tokens that a product of incidences takes at once, and the most nodes whose ids are broadcast to find their texts; more are joined by shuffle.
BLOCK = 256
BLOCK_TOKENS = 1 << 21
PRODUCT_TOKENS = 1 << 20
BROADCAST_ROWS = 500_000
#: Counters of the frequency table, and the parts it is summed in.
COUNTERS, SLICES = 1 << 20, 64
#: Tokens stored beyond the plain prefix: a share of it and a few more.
LONGER, MORE = 0.25, 4
#: Partners up to which a node's prefix is the plain one; each doubling demands one more shared token.
CHEAP = 512


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def token_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold the tokens of each counter; a counter stands for all tokens with its low bits."""
    width = COUNTERS // SLICES

    def count(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                np.add.at(total, np.concatenate(shingle_sets(encoded(part.column(0)), n)) & (COUNTERS - 1), 1)
        yield _slices({i: total[i * width : (i + 1) * width] for i in range(SLICES)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(raw, dtype=np.int64)
                sums[i] = sums[i] + part if i in sums else part
        yield _slices(sums)

    kind = "slice int, counts binary"
    sums = docs.select("text").mapInArrow(released(count), kind).repartition("slice").mapInArrow(released(add), kind).collect()
    out = np.zeros(COUNTERS, dtype=np.int64)
    for row in sums:
        out[row["slice"] * width : (row["slice"] + 1) * width] += np.frombuffer(row["counts"], dtype=np.int64)
    return out


def _slices(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], names=["slice", "counts"])


def ordered_tokens(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens as numbers in their order: the class of their frequency, then 52 bits of the hash."""
    return np.sort((classes[tokens & (COUNTERS - 1)] << 52) | ((tokens >> 12) & ((1 << 52) - 1)))


def document_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, key, size, prefix): a digest of the set, its size, its first tokens up to the longest prefix."""
    counts = token_counts(docs, n)
    frequency = docs.sparkSession.sparkContext.broadcast(np.floor(16 * np.log2(1.0 + counts)).astype(np.int64))

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1):
                sets = shingle_sets(encoded(part.column(1)), n)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                cut = [ordered_tokens(s, frequency.value)[: int(prefix_length(len(s), percent) * (1 + LONGER)) + MORE] if len(s) else s for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cut)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), prefix], names=["doc_id", "key", "size", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, key binary, size long, prefix array<long>")


def _bounded(ids: DataFrame) -> DataFrame:
    """ids marked for broadcast if they are few enough."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _plain(percent: int):
    return (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int")


def _shared_tokens(nodes: DataFrame, percent: int) -> DataFrame:
    """(family, node, size, token): the tokens of plain prefixes that another node's has too, under the token's
    least node as family. Counted before the join back, so that a frequent token is many rows of a join that can
    be split, not a group."""
    tokens = nodes.select("node", "size", F.explode(F.slice("prefix", F.lit(1), _plain(percent))).alias("token"))
    shared = tokens.groupBy("token").agg(F.min("node").alias("family"), F.max("node").alias("_last")).filter("family < _last").select(F.col("token").alias("_token"), "family")
    return tokens.join(shared, F.col("token") == F.col("_token")).select("family", "node", "size", "token")


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """members (family, node, size, ...) dealt to pairs of blocks: pair, side (0, 1, or 2 for a block with itself)."""
    # a little wider than the ratio, so that rounding never parts similar sizes by two classes
    width = math.log(100 / percent) * (1 + 1e-6)
    classed = members.withColumn("_class", F.floor(F.log(F.col("size").cast("double")) / width).cast("int"))
    counts = classed.groupBy(F.col("family").alias("_f"), F.col("_class").alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_t"))
    counts = counts.withColumn("_parts", F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_t") / BLOCK_TOKENS)).cast("int"))
    around = counts.select("_f", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_at"), "_c", "_parts")
    near = around.groupBy("_f", "_at").agg(
        F.max(F.when(F.col("_c") == F.col("_at") - 1, F.col("_parts"))).alias("_below"),
        F.max(F.when(F.col("_c") == F.col("_at"), F.col("_parts"))).alias("_own"),
        F.max(F.when(F.col("_c") == F.col("_at") + 1, F.col("_parts"))).alias("_above"),
    )
    counted = counts.select(F.col("_f").alias("_f2"), F.col("_c").alias("_c2"), "_n")
    near = near.join(counted, (F.col("_f") == F.col("_f2")) & (F.col("_at") == F.col("_c2")))
    # a node with no other of a similar length in the family has no partner there
    near = near.filter((F.col("_n") > 1) | F.col("_below").isNotNull() | F.col("_above").isNotNull()).drop("_f2", "_c2", "_n")
    dealt = classed.join(near, (F.col("family") == F.col("_f")) & (F.col("_class") == F.col("_at"))).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_own")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda c, a, d, b: F.struct(F.col("family").alias("family"), c.alias("c"), a.alias("a"), d.alias("d"), b.alias("b"))
    own, part = F.col("_class"), F.col("_part")
    same = F.transform(upto(F.col("_own")), lambda j: F.struct(name(own, F.least(part, j), own, F.greatest(part, j)).alias("pair"), F.when(j == part, 2).when(part < j, 0).otherwise(1).alias("side")))
    below = F.transform(upto(F.coalesce("_below", F.lit(0))), lambda j: F.struct(name(own - 1, j, own, part).alias("pair"), F.lit(1).alias("side")))
    above = F.transform(upto(F.coalesce("_above", F.lit(0))), lambda j: F.struct(name(own, part, own + 1, j).alias("pair"), F.lit(0).alias("side")))
    return dealt.select(*members.columns, F.inline(F.concat(same, below, above)))


def _paired(dealt: DataFrame, columns: list[str]) -> DataFrame:
    return dealt.select(F.xxhash64("pair.family", "pair.c", "pair.a", "pair.d", "pair.b").alias("pair"), "side", *columns)


def _grouped(keyed: DataFrame) -> DataFrame:
    """Rows of a pair of blocks side by side in one task, in an order of their own."""
    return keyed.repartition("pair").sortWithinPartitions("pair", "node")


def _runs(batches) -> Iterator[pa.Table]:
    """The groups of a stream that is ordered by its first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.asarray(batch.column(0))
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _shared_counts(tokens: list[np.ndarray]) -> np.ndarray:
    """Tokens that each two rows share, by the product of their incidence over tokens that occur twice. Many tokens
    are taken in turns, by remainder."""
    turns = -(-sum(map(len, tokens)) // PRODUCT_TOKENS)
    if turns > 1:
        return sum(_shared_counts_once([t[t % turns == k] for t in tokens]) for k in range(turns))
    return _shared_counts_once(tokens)


def _shared_counts_once(tokens: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(new) - 1
    twice = (np.bincount(number) > 1)[number]
    owner, number = owner[twice], number[twice]
    out = np.zeros((len(tokens), len(tokens)), dtype=np.float32)
    if not len(number):
        return out
    number = np.unique(number, return_inverse=True)[1]
    for lo in range(0, int(number[-1]) + 1, 8192):
        hit = (number >= lo) & (number < lo + 8192)
        x = np.zeros((len(tokens), min(8192, int(number[-1]) + 1 - lo)), dtype=np.float32)
        x[owner[hit], number[hit] - lo] = 1
        out += x @ x.T
    return out


def _wanted(side: np.ndarray) -> np.ndarray:
    """Which pairs a group is there for: all of a block with itself, else across its two blocks; once each."""
    across = (side[:, None] == 2) | (side[:, None] != side[None, :])
    return across & np.triu(np.ones((len(side), len(side)), dtype=bool), 1)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _rest(last: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """Tokens that each two nodes can share past the prefix that ends first."""
    return np.where(last[:, None] <= last[None, :], beyond[:, None], beyond[None, :])


def _plausible(percent: int, by_tokens: bool):
    """Nodes of a group that share enough of their prefixes with another one; without tokens, that can share it
    by the numbers of tokens (most) that any other node has too."""

    def run(batches):
        for group in _runs(batches):
            side, node, size = (np.asarray(group[c]) for c in ("side", "node", "size"))
            if len(node) < 2:
                continue
            demand, last, edge = (np.asarray(group[c]) for c in ("demand", "last", "edge"))
            plain = size - -(-percent * size // 100) + 1
            if by_tokens:
                shared = _shared_counts(_lists(group["tokens"]))
            else:
                shared = np.minimum.outer(*[np.asarray(group["most"])] * 2)
            rest = _rest(last, size - (plain + demand - 1))
            # a plain prefix comes without the tokens that only the other's extension has, so that extension is rest
            mixed = (demand[:, None] == 1) != (demand[None, :] == 1)
            rest = np.where(mixed, _rest(edge, size - plain), rest)
            # at least t / (1 + t) of both sizes must be common; past its prefix a set has no more than its rest
            needed = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
            good = _wanted(side) & (shared >= np.minimum(demand[:, None], demand[None, :])) & (shared + rest >= needed)
            good &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
            hit = good.any(axis=0) | good.any(axis=1)
            if hit.any():
                yield pa.RecordBatch.from_arrays([group["family"].combine_chunks().filter(pa.array(hit)), pa.array(node[hit]), pa.array(size[hit])], names=["family", "node", "size"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of links that join their ends' trees, in order."""
    root, out = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _verified(percent: int):
    """Links of a group by whole sets: enough to join what all its links join."""

    def run(batches):
        for group in _runs(batches):
            side, node, size = (np.asarray(group[c]) for c in ("side", "node", "size"))
            if len(node) < 2:
                continue
            shared = _shared_counts(_lists(group["tokens"])).astype(np.int64)
            union = size[:, None] + size[None, :] - shared
            a, b = np.nonzero(_wanted(side) & (100 * shared >= percent * union))
            if len(a):
                kept = _forest(a, b, len(node))
                yield pa.RecordBatch.from_arrays([pa.array(node[a[kept]]), pa.array(node[b[kept]])], names=["a", "b"])

    return run


def with_sets(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """rows (pair, side, node, size, key) with tokens, the whole sets, from the texts of the documents that nodes
    are named after. Few rows go to where the texts are. Of documents that share an id but not the text, those
    with the node's own set count."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 0):
                sets = shingle_sets(encoded(part.column(0)), n)
                keys = part.column(1).to_pylist()
                own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, keys, strict=True)]
                sets = [s for s, mine in zip(sets, own, strict=True) if mine]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.int64)])))
                rest = [c.filter(pa.array(own)) for c in part.columns[2:]]
                yield pa.RecordBatch.from_arrays([*rest, tokens], names=["pair", "side", "node", "size", "tokens"])

    wanted = docs.select(F.col("doc_id").alias("_id"), "text").join(_bounded(rows), F.col("_id") == F.col("node"))
    return wanted.select("text", "key", "pair", "side", "node", "size").mapInArrow(released(run), "pair long, side int, node long, size long, tokens array<long>")


def links(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes (key, node) and links (a, b) between their nodes that join all that similar sets join."""
    classes = sets.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("node"))
    classes = written(classes.filter(F.col("node").isNotNull()), "classes")
    # the copies are told apart by id, so that prefixes stay where they are
    named = sets.select("doc_id", F.col("key").alias("_key")).join(classes, F.col("_key") == F.col("key"))
    copies = written(named.filter(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("_copy"), "_key").distinct(), "copies")
    first = sets.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    nodes = first.join(_bounded(copies), (F.col("doc_id") == F.col("_copy")) & (F.col("key") == F.col("_key")), "left_anti").select(F.col("doc_id").alias("node"), "size", "prefix")
    shared = written(_shared_tokens(nodes, percent), "shared")
    families = written(shared.select("family", "node", "size").distinct(), "families")
    partners = families.groupBy(F.col("family").alias("_f")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    costs = families.join(partners, F.col("family") == F.col("_f")).groupBy("node").agg(F.sum("_n").alias("cost"))
    costs = written(costs.withColumnRenamed("node", "_node"), "costs")
    room = F.size("prefix") - _plain(percent)
    demand = F.greatest(F.lit(1), F.least(1 + room, 1 + F.floor(F.log2(F.col("cost") / CHEAP)))).cast("int")
    of = lambda some: nodes.join(_bounded(some), F.col("node") == F.col("_node"))
    ends = of(costs).withColumn("demand", demand).select("_node", "demand", F.get("prefix", _plain(percent) + F.col("demand") - 2).alias("last"), F.get("prefix", _plain(percent) - 1).alias("edge"))
    own = shared.groupBy(F.col("node").alias("_n2")).agg(F.collect_set("token").alias("tokens"))
    dear = F.col("demand") > 1
    longer = of(costs.filter(F.col("cost") >= 2 * CHEAP)).withColumn("demand", demand).filter(dear).select(F.col("_node").alias("_n3"), F.slice("prefix", F.lit(1), _plain(percent) + F.col("demand") - 1).alias("longer"))
    most = F.when(dear, F.size("longer")).otherwise(F.size("tokens")).cast("long").alias("most")
    sent = written(ends.join(own, F.col("_node") == F.col("_n2")).join(longer, F.col("_node") == F.col("_n3"), "left").select("_node", "demand", "last", "edge", most, F.coalesce("longer", "tokens").alias("tokens")), "sent")
    kind = "family long, node long, size long"
    met = families.join(partners.select("_f"), F.col("family") == F.col("_f"), "left_semi")
    ready = _blocks(met, percent).join(sent.drop("tokens"), F.col("node") == F.col("_node")).drop("_node")
    possible = written(_grouped(_paired(ready, ["family", "node", "size", "demand", "last", "edge", "most"])).mapInArrow(released(_plausible(percent, False)), kind).distinct(), "possible")
    ready = _blocks(possible, percent).join(sent, F.col("node") == F.col("_node")).drop("_node")
    plausible = _grouped(_paired(ready, ["family", "node", "size", "tokens", "demand", "last", "edge"])).mapInArrow(released(_plausible(percent, True)), kind).distinct()
    plausible = written(plausible, "plausible")
    # a node's sets are computed beside its text, once for each pair of blocks that wants them
    wanted = written(_paired(_blocks(plausible.join(classes, "node"), percent), ["node", "size", "key"]), "wanted")
    return classes, written(_grouped(with_sets(docs, wanted, n)).mapInArrow(released(_verified(percent)), "a long, b long").distinct(), "similar")


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; component_id: the least doc_id its links reach."""
    sets = written(document_sets(docs, n, percent), "sets")
    classes, found = links(docs, sets, n, percent)
    joined = components(found).withColumnRenamed("node", "_node")
    named = classes.join(joined, F.col("node") == F.col("_node"), "left").select(F.col("key").alias("_key"), F.coalesce("component", "node").alias("component"))
    out = sets.select("doc_id", "key", F.col("size").alias("n_shingles")).join(named, F.col("key") == F.col("_key"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that with the least doc_id. Rows with a null doc_id stay; of rows
    that share a doc_id one stays."""
    id, n_id = fresh(docs, "_id", "_n")
    labels = written(groups(docs, n, percent).select("doc_id", "component_id"), "groups")
    dropped = labels.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id)).distinct()
    rest = docs.join(_bounded(dropped), F.col("doc_id") == F.col(id), "left_anti")
    repeated = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(id)).agg(F.count(F.lit(1)).alias(n_id)).filter(F.col(n_id) > 1).select(id)
    if repeated.isEmpty():
        return rest
    single = rest.join(repeated, F.col("doc_id") == F.col(id), "left_anti")
    return single.unionByName(rest.join(repeated, F.col("doc_id") == F.col(id), "left_semi").dropDuplicates(["doc_id"]))
