"""Prefix trie of conversations by a merge sort that knows common prefixes.

A turn is a token of WIDTH bytes: half a SHA-256 of role and text, and the text's length in code points. Equal tokens are
equal turns, so a conversation's tokens, one after the other, are a key whose order groups conversations by their first
turns. Keys are dealt to tasks by ranges of (key, id), so copies of one conversation may spread over many tasks. A task
sorts runs of RUN_BYTES, front-coded: each entry carries how many turns it shares with the one before (its LCP) and only
the rest. More than one run goes to the shared folder and a loser tree merges them, FAN_IN at once: entries compare their
LCPs first and turns only beyond a common one, so what is shared is not compared again. The merged stream keeps a stack
of open nodes; a node is finished, with the counts of its subtree, once an entry leaves its path.

Only nodes on the path of a task's first or last entry may go on in another task. Their parts, at most two paths a task,
are folded in order by the same stack in one task that holds one path. A node's parent is found by a join on the number
that the task gave it.

Cases: turns go by number, null first, equal numbers by token; a null role or text is empty; rows without a conversation
id are left out; a base that does not exist gives no turns; repeated rows are turns of their own; equal conversations end
at the same node; an empty table gives an empty result, without a root; extra columns are left out. A conversation is one
row, of WIDTH bytes a turn, whatever the length of its texts; the ids that end at one node pass through one task as text,
as a digest of them has to.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, shared_dir, written

WIDTH = 20
#: Conversations whose numbers differ only below this share their base's first turns, up to OPENINGS - 1 of them.
FAMILY, OPENINGS = 100, 6
#: Bytes of keys that a task sorts in memory, runs merged at once, bytes of a batch of a run, rows of an output batch.
RUN_BYTES, FAN_IN, BATCH_BYTES, ROWS = 8 << 20, 32, 1 << 18, 2000
#: Ids in one piece of the list of a node that goes on in another task.
PIECE = 512

Entry = tuple[int, bytes, int]  # turns shared with the entry before, key, id

NODE = "pid int, open long, parent_open long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = [x.split()[0] for x in NODE.split(", ")]
PART = "part int, token binary, ends string"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, base and turns, the tokens of every conversation in hexadecimal."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    token = F.concat(F.substring(digest, 1, 32), F.lower(F.lpad(F.hex(F.char_length(text)), 8, "0")))
    own = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), token.alias("token")).alias("turn"))
    own = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "turn")
    # a family in one partition: then neither the grouping nor the join with the base shuffles again
    return own.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).withColumn("turns", F.col("turns.token"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id and key: the first h turns of the base, then the own turns after the first h, h from the id's CRC-32."""
    bases = own.filter("conv_id = base").select("base", F.slice("turns", 1, OPENINGS - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")
    opening = F.slice(F.coalesce("opening", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.join(bases, "base", "left").select("conv_id", F.unhex(F.array_join(F.concat(opening, rest), "")).alias("key"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two keys begin with alike, of which known are known."""
    low, high = known, min(len(a), len(b)) // WIDTH
    if a[low * WIDTH : high * WIDTH] == b[low * WIDTH : high * WIDTH]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


def run_of(items: list[tuple[bytes, int]]) -> Iterator[Entry]:
    """A sorted run with its LCPs."""
    items.sort()
    before = b""
    for key, conv in items:
        yield shared(before, key), key, conv
        before = key


def merge(runs: list[Iterator[Entry]]) -> Iterator[Entry]:
    """One sorted run of several. A head's LCP is that with the last entry that came out, so of two heads the one that
    shares more with it is the smaller, and only equal LCPs make turns be compared, from there on."""
    heads = [list(e) if (e := next(r, None)) else None for r in runs]
    n = len(runs)
    losers = [0] * n

    def match(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        both = shared(x[1], y[1], x[0])
        rest = slice(both * WIDTH, (both + 1) * WIDTH)
        won, lost = (a, b) if (x[1][rest], x[2]) < (y[1][rest], y[2]) else (b, a)
        heads[lost][0] = both
        return won, lost

    def play(node: int) -> int:
        if node >= n:
            return node - n
        won, losers[node] = match(play(2 * node), play(2 * node + 1))
        return won

    winner = play(1)
    while heads[winner] is not None:
        yield tuple(heads[winner])
        heads[winner] = list(e) if (e := next(runs[winner], None)) else None
        node = (winner + n) // 2
        while node:
            winner, losers[node] = match(winner, losers[node])
            node //= 2


class Spill:
    """Runs as files in the shared folder; of each entry the turns after those shared with the one before."""

    schema = pa.schema([("lcp", pa.int32()), ("rest", pa.large_binary()), ("conv", pa.int64())])

    def __init__(self, target: str) -> None:
        self.store, folder = fs.FileSystem.from_uri(target)
        self.folder = f"{folder}/trie-{uuid.uuid4().hex}"
        self.files = 0

    def write(self, run: Iterator[Entry]) -> str:
        self.store.create_dir(self.folder)
        path = f"{self.folder}/{self.files}.arrow"
        self.files += 1
        with self.store.open_output_stream(path) as out, pa.ipc.new_stream(out, self.schema) as writer:
            lcps, rests, convs, size = [], [], [], 0
            for lcp, key, conv in run:
                lcps.append(lcp)
                rests.append(key[lcp * WIDTH :])
                convs.append(conv)
                size += len(rests[-1]) + 64
                if size >= BATCH_BYTES:
                    writer.write_batch(pa.record_batch([lcps, rests, convs], schema=self.schema))
                    lcps, rests, convs, size = [], [], [], 0
            if lcps:
                writer.write_batch(pa.record_batch([lcps, rests, convs], schema=self.schema))
        return path

    def read(self, path: str) -> Iterator[Entry]:
        key = b""
        with self.store.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
            for batch in reader:
                for lcp, rest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = key[: lcp * WIDTH] + rest
                    yield lcp, key, conv

    def clear(self) -> None:
        if self.files:
            self.store.delete_dir(self.folder)


def ordered(items: Iterator[tuple[bytes, int]], spill: Spill) -> Iterator[Entry]:
    """Entries in order, by runs that fit in memory."""
    held, size, runs = [], 0, []
    for item in items:
        held.append(item)
        size += len(item[0]) + 96
        if size >= RUN_BYTES:
            runs.append(spill.write(run_of(held)))
            held, size = [], 0
    if not runs:
        yield from run_of(held)
        return
    if held:
        runs.append(spill.write(run_of(held)))
    while len(runs) > FAN_IN:
        runs = [spill.write(merge([spill.read(r) for r in runs[i : i + FAN_IN]])) for i in range(0, len(runs), FAN_IN)]
    yield from merge([spill.read(r) for r in runs])


@dataclass
class Node:
    token: bytes
    at: tuple[int, int]
    parent: tuple[int, int]
    convs: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    first: bool = False
    ends: list = field(default_factory=list)
    digest: object = None
    places: list = field(default_factory=list)

    def met(self, convs: int, least: int | None) -> None:
        self.convs += convs
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def finish(self, above: Node | None) -> None:
        """Counts the node itself, all of whose children are finished, and adds it to the one above."""
        self.leaves = self.leaves or 1
        self.saved += (self.convs - 1) * int.from_bytes(self.token[-4:], "big")
        if above:
            above.met(self.convs, self.least)
            above.children += 1
            above.leaves += self.leaves
            above.saved += self.saved

    def row(self, depth: int, ends_sha256: str | None) -> tuple:
        return (*self.at, self.parent[1], depth, self.least, self.convs, self.children, self.leaves, self.saved, ends_sha256)


def nodes(entries: Iterator[Entry], pid: int) -> Iterator[tuple]:
    """Rows of finished nodes, then the parts of those on the first and the last path, in the order in which they were
    opened. A part counts what ended at it and its finished children, not the other parts below it."""
    stack: list[Node] = []
    parts: list[tuple[int, Node]] = []
    opened = 0
    for lcp, key, conv in entries:
        first = not stack
        while len(stack) > lcp + 1:
            node = stack.pop()
            if node.first:
                parts.append((len(stack), node))
                continue
            node.finish(stack[-1])
            yield (*node.row(len(stack), hashlib.sha256(",".join(node.ends).encode()).hexdigest()), None, None, None)
        for depth in range(len(stack), len(key) // WIDTH + 1):
            token = key[(depth - 1) * WIDTH : depth * WIDTH] if depth else b""
            stack.append(Node(token, (pid, opened), stack[-1].at if stack else (pid, -1), first=first))
            opened += 1
        stack[-1].met(1, conv)
        stack[-1].ends.append(str(conv))
    parts += enumerate(stack)
    for depth, node in sorted(parts, key=lambda x: x[1].at):
        for part in range(max(1, -(-len(node.ends) // PIECE))):
            yield (*node.row(depth, None), part, node.token, ",".join(node.ends[part * PIECE : (part + 1) * PIECE]))


def folded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The nodes that parts of several tasks make up, and then each of their places, from parts in order."""
    stack: list[Node] = []

    def close() -> Iterator[tuple]:
        node = stack.pop()
        node.finish(stack[-1] if stack else None)
        yield (*node.row(len(stack), node.digest.hexdigest()), True)
        for place in node.places[1:]:
            yield (*place, None, len(stack), node.least, node.convs, node.children, node.leaves, node.saved, None, False)

    for pid, at, parent, depth, least, convs, children, leaves, saved, _, part, token, ends in rows:
        if len(stack) <= depth or stack[depth].token != token:
            while len(stack) > depth:
                yield from close()
            stack.append(Node(token, (pid, at), (pid, parent), digest=hashlib.sha256()))
        node = stack[depth]
        if part == 0:
            node.places.append((pid, at))
            node.met(convs, least)
            node.children += children
            node.leaves += leaves
            node.saved += saved
        if ends:
            node.digest.update(("," if node.ends else "").encode() + ends.encode())
            node.ends = [True]
    while stack:
        yield from close()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.record_batch(list(map(list, zip(*held, strict=True))), schema=schema)
            held = []
    if held:
        yield pa.record_batch(list(map(list, zip(*held, strict=True))), schema=schema)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


def trie(keys: DataFrame) -> DataFrame:
    """A row per node of the trie of the keys: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    target = shared_dir(keys.sparkSession)
    kinds, fold_kinds = f"{NODE}, {PART}", f"{NODE}, whole boolean"

    def built(batches):
        spill = Spill(target)
        items = (x for b in batches for x in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))
        try:
            yield from _batches(nodes(ordered(items, spill), TaskContext.get().partitionId()), _schema(kinds))
        finally:
            spill.clear()

    def fold(batches):
        yield from _batches(folded(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), _schema(fold_kinds))

    dealt = written(keys.select("conv_id", "key"), "trie-keys").repartitionByRange("key", "conv_id")
    found = written(dealt.mapInArrow(released(built), kinds), "trie-nodes")
    parts = found.filter("part IS NOT NULL").repartition(1).sortWithinPartitions("pid", "open", "part")
    edges = written(parts.mapInArrow(released(fold), fold_kinds), "trie-edges")
    done = found.filter("part IS NULL").select(*NODE_COLUMNS).unionByName(edges.filter("whole").select(*NODE_COLUMNS))
    above = found.filter("part IS NULL AND n_children > 0").unionByName(edges, allowMissingColumns=True)
    above = above.select("pid", F.col("open").alias("parent_open"), F.col("conv_id").alias("parent_conv_id"))
    return done.join(above, ["pid", "parent_open"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(sequences(conversations)))
