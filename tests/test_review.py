"""Frames of the review screen against a plain version, and the query against its SQL on odd rows."""

import math
import random

import duckdb
import numpy as np

import __spark_entry__ as entry
from tastegrid.operators import review
from tastegrid.operators.review import Anchor

from .test_oracle import compare


def _plain(frames, models):
    """Family by family: the frame farthest above the dead zone that is still free; then the most central one."""
    read = lambda a, v: v[a.at] if v[a.at] is not None and math.isfinite(v[a.at]) else None
    chosen = []
    for family in dict.fromkeys(a.family for a in models):
        best = None
        for file, v in sorted(frames, key=lambda f: f[0]):
            gaps = [(a, read(a, v) - a.centre - a.dead) for a in models if a.family == family and read(a, v) is not None]
            excess = max([abs(a.gain * g) / max(1.0, abs(a.gain) * (a.dead or 1.0)) for a, g in gaps if g > 0], default=0)
            if file not in [f for _, f, _ in chosen] and excess > 0 and (best is None or excess > best[2]):
                best = (family, file, excess)
        chosen += [best] if best else []
    free = [(f, v) for f, v in frames if f not in [c[1] for c in chosen] and any(read(a, v) is not None for a in models)]
    off = lambda v: max(abs(read(a, v) - a.centre) / (a.dead or 1.0) for a in models if read(a, v) is not None)
    return chosen + [(None, f, o) for o, f in sorted((off(v), f) for f, v in free)[:1]]


def _frames(spark, rows):
    return spark.createDataFrame(rows, "file string, v array<double>").repartition(3)


def test_no_frame_twice_none_below_its_zone_and_a_control(spark):
    models = [Anchor("a", 0, 10.0, 2.0, 1.0), Anchor("b", 1, 10.0, -0.5, 1.0), Anchor("c", 2, 0.0, 1.0, 5.0)]
    # f0 is highest in a and in b; f1 is farthest from b's centre, but below it; nothing is above c's zone
    rows = [("f0", [20.0, 20.0, 5.0]), ("f1", [9.0, -90.0, 0.0]), ("f2", [10.5, 12.0, 0.0]), ("f3", [10.0, 10.5, 1.0]), ("f4", [10.0, 10.5, 1.0]), ("f5", [None, math.nan, None])]
    assert review.picked(_frames(spark, rows), "file", "v", models) == [("a", "f0", 9.0), ("b", "f2", 0.5), (None, "f3", 0.5)]
    assert review.picked(_frames(spark, rows), "file", "v", []) == []
    assert review.picked(_frames(spark, rows[5:]), "file", "v", models) == []


def test_picks_are_those_of_one_family_after_the_other(spark):
    rnd = random.Random(5)
    for _ in range(6):
        # few values: many ties; families of several anchors, without a dead zone, without a gain
        odd = [None, math.nan, math.inf]
        rows = [(f"f{rnd.randrange(40):02d}", [rnd.choice(odd) if rnd.random() < 0.1 else float(rnd.randrange(-4, 5)) for _ in range(6)]) for _ in range(45)]
        models = [Anchor(rnd.choice("abcde"), i, rnd.choice([0.0, 0.25]), rnd.choice([0.0, 0.3, -2.0, 7.0]), rnd.choice([0.0, 0.5, 2.0])) for i in range(6)]
        assert review.picked(_frames(spark, rows), "file", "v", models) == _plain(rows, models)


def test_anchors_are_the_least_squares_fit_outside_the_dead_zone(spark):
    rnd = random.Random(6)
    x = [rnd.gauss(3, 2) for _ in range(400)]
    y = [1 + 4 * max(v - 4, 0) + min(v - 2, 0) + rnd.gauss(0, 0.1) for v in x]
    rows = [(f"f{i}", [v, 1.0, math.nan if i > 50 else v], [w, w, w]) for i, (v, w) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, ("g", None, None), ("h", [math.inf, 0.0, 0.0], [0.0, math.nan, None])], "file string, v array<double>, y array<double>")
    # what does not vary and what has too few rows has no anchor
    (got,) = review.anchored(df, ["a", "b", "c"], "v", "y", 0.5)
    gap, dead = np.array(x) - np.mean(x), 0.5 * np.std(x)
    fit = np.linalg.lstsq(np.stack([np.ones(400), np.maximum(gap - dead, 0), np.minimum(gap + dead, 0)], 1), np.array(y), rcond=None)[0]
    assert (got.family, got.at) == ("a", 0) and np.allclose([got.centre, got.gain, got.dead], [np.mean(x), fit[1], dead], atol=2e-6)


def test_review_frames_is_its_sql_on_odd_rows(spark, tmp_path):
    rnd = random.Random(7)
    price = lambda i: [None, math.nan, 50_000.0][i % 3] if i % 11 == 0 else round(rnd.uniform(900, 9000), 2)
    rows = [(i, 1, i % 4, 1 + i % 3, float(1 + i % 50), price(i), i % 11 / 100, None if i % 7 == 0 else i % 9 / 100, "A", "F") for i in range(300)]
    # the first frame is the highest in all families, another is far below, one has nothing to read
    rows += [(1000, 1, 0, 1, 60.0, 60_000.0, 0.2, 0.2, "A", "F"), (1001, 1, 0, 1, -60.0, -60_000.0, -0.3, -0.3, "A", "F"), (1002, 1, 0, 1, None, None, None, None, "A", "F")]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = entry.queries()["review_frames"](spark, str(tmp_path))
    got = df.orderBy("place").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()["review_frames"])
    compare([tuple(r) for r in got], df.columns, rel.fetchall(), list(rel.columns))
    assert [r["param"] for r in got] == ["quantity", "price", "discount", "tax", None] and len({r["file"] for r in got}) == 5
    assert got[0]["file"] == "/cat/0/1000-1-1" and not any("/1001-" in r["file"] or "/1002-" in r["file"] for r in got)


def test_review_frames_without_rows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert entry.queries()["review_frames"](spark, str(tmp_path)).collect() == []
