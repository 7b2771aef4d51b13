"""The conversation trie and the clusters against plain versions, and their odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import conversation_trie as trie
from tastegrid.llm import kd_clusters
from tastegrid.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    own = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    built = {c: own.get(c - int(math.fmod(c, 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + own[c][h:] for c in own}
    at = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            at.setdefault(tuple(built[c][:d]), []).append(c)
    out = []
    for k, members in at.items():
        below = [x for x in at if x[: len(k)] == k]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        saved = sum((len(at[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(k))
        out.append((members[0], len(k), at[k[:-1]][0] if k else None, len(members), sum(len(x) == len(k) + 1 for x in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def few_texts(n, families=3, copies=40, seed=1):
    """Conversations over few texts, so that prefixes are shared, and many copies of one."""
    rnd = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        i = int(rnd.integers(families)) * 100 + c // families if c else 0
        rows += [(i, int(t), ("user", "assistant", None)[int(rnd.integers(3))], ("a", "bé", "", None, "long text")[int(rnd.integers(5))]) for t in range(int(rnd.integers(1, 9)))]
    seen = {}
    rows = [(c, seen.setdefault(c, []).append(0) or len(seen[c]), r, x) for c, _, r, x in rows]
    for c in range(copies):
        rows += [(5000 + c, t, "user", "same") for t in range(3)]
    return rows


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_trie(spark, monkeypatch, partitions):
    rows = few_texts(60)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(0, None, "user", "x"), (0, -1, None, None), (0, 5, "user", "y" * 5000), (None, 1, "user", "gone"), (7, 1, "user", "x"), (107, 1, "user", "x"), (107, 2, "user", "x"), (207, None, None, None), (-5, 3, "user", "z")]
    rows += [(300, t, "user", f"t{t}") for t in range(700)] + [(301, t, "user", f"t{t}") for t in range(650)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("own") for c in ("depth", "n_convs", "key", "base", "part")})
    got = sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)
    few = [r for r in rows if r[0] not in (300, 301)]
    assert len(got) > 700 and max(r[1] for r in got) == 700
    assert sorted((tuple(r) for r in trie.prefix_trie(df.filter("coalesce(conv_id, 0) NOT IN (300, 301)")).collect()), key=str) == plain_trie(few)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_runs_are_spilled_and_merged(monkeypatch, tmp_path):
    """Small runs, merged two at a time: the same entries and LCPs as one sort gives."""
    rnd = np.random.default_rng(3)
    turns = [bytes(rnd.integers(0, 256, trie.WIDTH, dtype=np.uint8)) for _ in range(3)]
    items = [(b"".join(turns[i] for i in rnd.integers(0, 3, int(rnd.integers(0, 9)))), int(rnd.integers(-9, 9))) for _ in range(700)]
    want = list(trie.run_of(list(items)))
    monkeypatch.setattr(trie, "RUN_BYTES", 4000)
    monkeypatch.setattr(trie, "FAN_IN", 3)
    monkeypatch.setattr(trie, "BATCH_BYTES", 1000)
    spill = trie.Spill(f"file://{tmp_path}")
    assert list(trie.ordered(iter(items), spill)) == want and spill.files > 20
    spill.clear()
    assert not list(tmp_path.iterdir())


def test_merge_compares_no_shared_turn_again(monkeypatch):
    """Keys that share 1000 turns: beyond the first entries every comparison starts after the shared ones."""
    calls = []
    real = trie.shared
    monkeypatch.setattr(trie, "shared", lambda a, b, known=0: calls.append(known) or real(a, b, known))
    token = lambda i: i.to_bytes(trie.WIDTH, "big")
    head = b"".join(token(i) for i in range(1000))
    runs = [list(trie.run_of([(head + token(i * 8 + r), i) for i in range(50)])) for r in range(8)]
    calls.clear()
    assert [k for _, k, _ in trie.merge([iter(r) for r in runs])] == sorted(k for r in runs for _, k, _ in r)
    assert sum(k < 1000 for k in calls) <= 8


def plain_clusters(vectors, k=40, rounds=5):
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        mine = {}
        for _, v in rows:
            mine.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if j in mine else w for j, w in enumerate(c)]
    found = [(i, *near(v)) for i, v in rows]
    of = lambda j: sum(d for _, d, m in found if m == j)
    return sorted(((i, j, d, of(j), sum(x[1] for x in found), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=str)


@pytest.mark.parametrize("leaf", [1, 8, 4096])
def test_clusters(spark, monkeypatch, leaf):
    """Tight groups, equal vectors, ties between equal centroids, empty centroids, rows that are left out."""
    monkeypatch.setattr(kd_clusters, "LEAF", leaf)
    rnd = np.random.default_rng(5)
    heart = rnd.normal(size=(6, 64))
    vectors = [(i, (heart[i % 6] + (rnd.normal(size=64) * 0.02 if i % 4 else 0)).tolist()) for i in range(200)]
    vectors += [(1000 + i, [0.5] * 64) for i in range(50)] + [(None, [0.25] * 64), (7, [0.1] * 64), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [1.0] * 63 + [float("nan")]), (2004, [float("inf")] * 64)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cluster", "distance", "vector", "id", "inertia")})
    got = kd_clusters.clustered(df.repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(vectors)


def test_clusters_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [-0.5] * 64)], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["distance"]) for r in kd_clusters.clustered(df).collect()) == [(1, 0), (1, 0), (2, 0)]
    assert kd_clusters.clustered(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        kd_clusters.clustered(spark.createDataFrame([(1, [1e9] * 64)], df.schema)).collect()


def test_trees_prune(spark):
    """On tight groups most vectors are given out with whole nodes, and exactly."""
    rnd = np.random.default_rng(9)
    heart = rnd.integers(-200, 200, (12, 64))
    points = heart[rnd.integers(0, 12, 3000)] + rnd.integers(-2, 3, (3000, 64))
    _, tree = kd_clusters.build(points)
    whole = 0
    for i, found in tree.walk(heart):
        part = tree.points[tree.first[i] : tree.last[i]]
        assert np.array_equal(kd_clusters.nearest(part, heart), np.broadcast_to(found, len(part)))
        whole += len(part) * isinstance(found, int)
    assert whole > 1500
    assert np.array_equal(kd_clusters.nearest(points << 17, heart << 17), kd_clusters.nearest(points, heart))


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_centroid_clusters"])
def test_queries_twice(spark, name):
    """Reruns give the same rows."""
    rows = [sorted((tuple(r) for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str) for _ in range(2)]
    assert rows[0] == rows[1]
