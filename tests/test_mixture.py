"""Mixtures of styles, held-out deltas and branches of few frames, against plain refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import develop, evaluate, folds, mixture, moments

SCHEMA = "file string, session int, x array<double>, y array<double>, style array<double>"


def _styled(spark, mixed, n=600, seed=3):
    """Edits that follow a feature one way or, in the other style, the other way."""
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, s = rnd.normal(size=2), 1 if rnd.random() < 0.5 else -1
        slope = 2.0 * s if mixed else 2.0
        rows.append((f"f{i}", i % 30, x.tolist(), [float(slope * x[0] + 0.1 * rnd.normal()), float(rnd.normal())], [float(s + 0.1 * rnd.normal()), float(0.1 * rnd.normal())]))
    return spark.createDataFrame(rows, SCHEMA)


def test_a_planted_mixture_is_found(spark):
    found = mixture.diagnosed(_styled(spark, True), "session", "x", "y", "style", [2.0, 1.0], emphasis=[3.0, 1.0])
    skills = dict(found.skills)
    assert skills[1] < 0.1 and skills[2] > 0.85 and found.gain() > 0.75
    two = [r for r in found.clusters if r[0] == 2]
    assert sum(r[2] for r in two) == 600 and sorted(round(r[4][0]) for r in two) == [-1, 1]


def test_one_style_gains_nothing(spark):
    found = mixture.diagnosed(_styled(spark, False), "session", "x", "y", "style", [2.0, 1.5])
    assert dict(found.skills)[1] > 0.4 and abs(found.gain()) < 0.05


def test_small_clusters_and_targets_that_do_not_vary(spark):
    df = _styled(spark, True, 40).withColumn("y", F.array(F.get("y", 0), F.lit(1.0)))
    found = mixture.diagnosed(df, "session", "x", "y", "style", [2.0, 2.0], clusters=(4,))
    assert any(p is None for c, _, n, p, _ in found.clusters if n < 15) and all(s is not None for _, s in found.skills)
    with pytest.raises(ValueError, match="too few"):
        mixture.diagnosed(df.limit(10), "session", "x", "y", "style", [2.0, 2.0])


def test_clusters_do_not_depend_on_how_rows_lie(spark):
    """Even noise, which has several ways to be parted, gives the same clusters from one part as from many; they are
    where plain rounds from them stay, and all numbers of clusters share their passes."""
    rnd = np.random.default_rng(11)
    rows = [(f"f{i}", i % 40, rnd.normal(size=2).tolist(), rnd.normal(size=2).tolist(), rnd.random(2).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.sparkContext.setJobGroup("mixture", "clusters")
    one, many = (mixture.diagnosed(d, "session", "x", "y", "style", [2.0, 2.0]) for d in (df.coalesce(1), df.repartition(7)))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixture"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r[:3] for r in one.clusters] == [r[:3] for r in many.clusters] and np.allclose([s for _, s in one.skills], [s for _, s in many.skills])
    assert jobs <= 2 * (mixture.ROUNDS + mixture.STARTS + 14)
    style, spread = np.array([r[4] for r in rows]), np.array([r[4] for r in rows]).std(axis=0)
    for c in (2, 3, 4):
        mean = np.array([r[4] for r in one.clusters if r[0] == c]) / spread
        place = mixture._nearest(style / spread, mean)[0]
        moved = np.array([(style / spread)[place == j].mean(axis=0) for j in range(c)])
        assert np.abs(moved - mean).max() < 0.02


def test_blocks_hold_every_row_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK_NUMBERS", 40)
    rows = [(f"k{i % 3}" if i % 7 else None, [float(i), float(i * i)]) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, z array<double>").repartition(3)
    add = lambda key, z, w: np.array([w.sum(), *z.sum(axis=0)])
    found = moments.sums_of_blocks(moments.packed(df, 2), 2, add)
    plain = moments.sums_by_key(df.withColumn("w", F.lit(1.0)), 2, add)
    assert found.keys() == plain.keys() == {"k0", "k1", "k2"}
    for key, (n, sums) in found.items():
        own = [z for k, z in rows if k == key]
        assert n == plain[key][0] == len(own) and sums.tolist() == plain[key][1].tolist() == [len(own), *np.sum(own, axis=0)]


def _plain(x, y, penalty):
    """Ridge on columns over their spreads, penalty times the rows."""
    mean, my, spread = x.mean(axis=0), y.mean(axis=0), x.std(axis=0)
    z = (x - mean) / spread
    b = np.linalg.solve(z.T @ z + penalty * len(x) * np.eye(x.shape[1]), z.T @ (y - my)) / spread[:, None]
    return b, my - mean @ b


def test_held_out_deltas_equal_plain_refits(spark):
    df = folds.dealt(_styled(spark, False, 200), "session", 4)
    rows = df.collect()
    got = {r["file"]: r for r in evaluate.held_out_deltas(df, "file", "x", "y", [0.1, 10.0], responses=[1.0, 0.5]).collect()}
    assert len(got) == 200
    for f in range(4):
        rest = [r for r in rows if r["fold"] != f]
        x, y = np.array([r["x"] for r in rest]), np.array([r["y"] for r in rest])
        (b1, c1), (b2, c2), mean = _plain(x, y, 0.1), _plain(x, y, 10.0), y.mean(axis=0)
        for r in rows:
            if r["fold"] == f:
                v = np.array(r["x"])
                want = [(v @ b1 + c1)[0], mean[1] + 0.5 * ((v @ b2 + c2)[1] - mean[1])]
                assert np.allclose(got[r["file"]]["predicted"], want, atol=1e-8) and np.allclose(got[r["file"]]["constant"], mean) and got[r["file"]]["truth"] == r["y"]
    assert evaluate.held_out_deltas(df.limit(0), "file", "x", "y", 1.0).count() == 0
    lone = evaluate.held_out_deltas(df.limit(2).withColumn("fold", F.when(F.col("file") == df.first()["file"], 0).otherwise(1)), "file", "x", "y", 1.0).collect()
    assert all(r["predicted"] == [0.0, 0.0] for r in lone)


def test_branches_by_their_frames(spark):
    df = _styled(spark, False, 120).withColumn("n", F.substring("file", 2, 9).cast("int"))
    df = df.withColumn("treatment", F.when(F.col("n") < 100, "color").when(F.col("n") < 112, "bw").when(F.col("n") < 115, "sepia"))
    found = develop.train_dataset(df, "treatment", "session", "x", "y", ["a", "b"])
    assert sorted(found.branches) == ["bw", "color"] and list(found.left_out) == ["sepia"] and list(found.unevaluated) == ["bw"]
    assert found.branches["color"].skill is not None and found.branches["color"].skill[0] > 0.5
    small = found.branches["bw"]
    assert small.skill is None and not small.level.gated[0] and len(small.rows()) == 4
    told = develop.predicted(df, small, "session", "x", facts=small.guards).select("a", F.get("y", 0).alias("y")).collect()
    assert np.corrcoef([r["a"] for r in told], [r["y"] for r in told])[0, 1] > 0.4
    with pytest.raises(ValueError, match="sepia"):
        develop.train_dataset(df.filter("treatment = 'sepia'"), "treatment", "session", "x", "y", ["a", "b"])
    with pytest.raises(ValueError, match="too few"):
        develop.train_dataset(df.limit(1), "treatment", "session", "x", "y", ["a", "b"])


def test_structure_against_shuffled_columns(spark):
    """Three tight groups are explained and their nulls are not; noise is explained no better than its nulls. A null
    keeps every column's values."""
    from tastegrid.operators import structure

    rnd = np.random.default_rng(4)
    heart = rnd.normal(size=(3, 6)) * 5
    groups = [(i, (heart[i % 3] + rnd.normal(size=6) * 0.2).tolist() + [1.0]) for i in range(240)]
    noise = [(i, rnd.normal(size=7).tolist()) for i in range(240)]
    frame = lambda rows: spark.createDataFrame(rows, "i int, v array<double>")
    (_, told, nulls), (_, plain, others) = (structure.structure(frame(r), "i", "v", clusters=(3,), nulls=2)[0] for r in (groups, noise))
    assert told > 0.9 and max(nulls) < 0.75 and abs(plain - np.mean(others)) < 0.1
    df = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(30)], "_r long, _z array<double>")
    moved = [r["_z"] for r in structure.shuffled(df, 30, 3).collect()]
    assert sorted(v[0] for v in moved) == [float(i) for i in range(30)] and sorted(v[1] for v in moved) == sorted(float(i * i) for i in range(30))
    assert sum(v[0] ** 2 != v[1] for v in moved) > 20
