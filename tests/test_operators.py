"""Operators on literals and on synthetic data with a known answer."""

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tastegrid.functions import arrays, color, jsmath, language, raster, text
from tastegrid.operators import anchors, develop, evaluate, feedback, folds, keyed, keywords, library, moments, ordered, ranking, sessions
from tastegrid.sources import jsonl
from tastegrid.streaming import online


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_and_ranks(spark):
    assert [one(spark, jsmath.round_half_up(F.lit(v))) for v in (-2.5, 2.5, -2.51)] == [-2.0, 3.0, -3.0]
    v = F.array(*[F.lit(float(i)) for i in range(10)])
    assert one(spark, jsmath.nearest_rank(v, 0.5)) == 5.0 and one(spark, jsmath.floor_rank(v, 0.8)) == 8.0 and one(spark, jsmath.floor_rank(v, 1.0)) == 9.0
    assert one(spark, jsmath.or_else(F.lit(0.0), 1.0)) == 1.0


def test_curves_and_grids(spark):
    p = lambda *xy: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])
    assert one(spark, arrays.sampled_curve(p((100, 50), (0, 0)), [0, 50, 100, 255])) == [0.0, 25.0, 50.0, 50.0]
    assert one(spark, arrays.sampled_curve(p((1, 2)), [0, 9])) == [0.0, 9.0]
    grid = F.array(*[F.lit(i) for i in range(6)])
    assert one(spark, arrays.oriented(grid, 3, 2, 1)) == [0, 1, 2, 3, 4, 5] and one(spark, arrays.oriented(grid, 3, 2, 3)) == [5, 4, 3, 2, 1, 0]
    assert one(spark, arrays.oriented(grid, 3, 2, 6)) == [3, 0, 4, 1, 5, 2]


def test_text(spark):
    assert one(spark, text.sanitized(F.lit(" a/b  c:"))) == "a-b-c"
    assert one(spark, text.common_folder(F.array(*map(F.lit, ("/a/b/c.x", "/a/b/d/e.x", "/a/b/f.x"))))) == "/a/b"
    assert [one(spark, text.parsed_time(F.lit(s))) for s in ("7:05", "24:00", "1:60", "x")] == [425, None, None, None]
    with pytest.raises(ValueError):
        text.rendered("{nothing}", {}, {})


def test_daylight_is_neutral(spark):
    r, g, b = one(spark, color.balance_gains(F.lit(6504.0)))
    assert max(abs(x - 1) for x in (r, g, b)) < 0.12
    warm = one(spark, color.balance_gains(F.lit(3000.0)))
    assert warm[2] > warm[0]


def test_moves_swap_and_replace(spark):
    marks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, v int")
    moves = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("x", "a")], "old string, new string")
    assert sorted(map(tuple, keyed.moved(marks, moves, "k").collect())) == [("a", 2), ("b", 1), ("d", 3)]


def test_folds_keep_sessions_whole(spark):
    df = spark.createDataFrame([(s, i) for s in range(11) for i in range(s + 1)], "session int, i int")
    dealt = folds.balanced(df, "session", 3).collect()
    weights = [sum(r["n"] for r in dealt if r["fold"] == f) for f in range(3)]
    assert len(dealt) == 11 and max(weights) - min(weights) <= 11


def _planted(spark, noise, seed=1):
    rnd = np.random.default_rng(seed)
    rows = []
    for s in range(25):
        for i in range(20):
            x = rnd.normal(size=3)
            rows.append((f"{s}/{i}", s, x.tolist(), [float(2 * x[0] - x[1] + 3 + noise * rnd.normal()), float(rnd.normal())]))
    return spark.createDataFrame(rows, "file string, session int, x array<double>, y array<double>")


def test_moments_solve_like_numpy(spark):
    df = _planted(spark, 0.5)
    m = moments.total(moments.collect(df, "x", "y", "session"))
    b, c = moments.ridge(m, 0.0, per_weight=True)
    rows = df.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    want = np.linalg.lstsq(np.column_stack((np.ones(len(x)), x)), y, rcond=None)[0]
    assert np.allclose(b, want[1:], atol=1e-8) and np.allclose(c, want[0], atol=1e-8)
    axes, share = moments.principal(m, 3)
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-9) and math.isclose(share.sum(), 1, rel_tol=1e-9)


def _plain_skill(rows, fold, k, penalty, standard=True):
    """Held-out predictions of a standardised ridge, fold by fold, and of the training mean."""
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    said, mean = np.zeros_like(y), np.zeros_like(y)
    for f in range(k):
        t, v = fold != f, fold == f
        mx, sx, my = x[t].mean(axis=0), x[t].std(axis=0), y[t].mean(axis=0)
        z = (x[t] - mx) / sx
        b = np.linalg.solve(z.T @ z + penalty * t.sum() * np.eye(3), z.T @ (y[t] - my))
        said[v], mean[v] = ((x[v] - mx) / sx) @ b + my, my
    return y, said, mean


def test_skills_like_plain_folds(spark):
    df = evaluate.with_folds(_planted(spark, 0.5), "session", 5).cache()
    rows = df.collect()
    fold = np.array([r["fold"] for r in rows])
    got = {(r["penalty"], r["target"]): r for r in evaluate.skills(df, "x", "y").collect()}
    for penalty in (0.1, 3.0):
        y, said, mean = _plain_skill(rows, fold, 5, penalty)
        for t in (0, 1):
            r, c, d = got[penalty, t], (said - mean)[:, t], (y - mean)[:, t]
            assert math.isclose(r["mae"], np.abs(y - said)[:, t].mean(), rel_tol=1e-9) and math.isclose(r["baseline"], np.abs(y - mean)[:, t].mean(), rel_tol=1e-9)
            slope = np.clip(((c * d).mean() - c.mean() * d.mean()) / c.var(), 0, evaluate.MAX_RESPONSE)
            assert math.isclose(r["response"], slope, rel_tol=1e-6, abs_tol=1e-9)
            shipped = 1 - np.abs(y[:, t] - mean[:, t] - slope * c).mean() / r["baseline"]
            assert math.isclose(r["shipped"], shipped, rel_tol=1e-6, abs_tol=1e-9)


def test_nested_skill_never_sees_its_fold(spark):
    """The skill of the whole procedure: each fold's penalty is chosen by the other folds among themselves."""
    df = evaluate.with_folds(_planted(spark, 3.0, seed=6), "session", 4).cache()
    rows = df.collect()
    fold, y = np.array([r["fold"] for r in rows]), np.array([r["y"] for r in rows])
    found = evaluate.judged(df, "x", "y")
    missed, base = np.zeros(2), np.zeros(2)
    for f in range(4):
        train = [r for r in rows if r["fold"] != f]
        inner = np.array([r["fold"] for r in train])
        order = [g for g in range(4) if g != f]
        compact = np.array([order.index(g) for g in inner])
        for t in (0, 1):
            told = {}
            for p in evaluate.PENALTIES:
                yy, said, mean = _plain_skill(train, compact, 3, p)
                c, d = (said - mean)[:, t], (yy - mean)[:, t]
                slope = np.clip(((c * d).mean() - c.mean() * d.mean()) / c.var(), 0, evaluate.MAX_RESPONSE)
                told[p] = 1 - np.abs(d - slope * c).sum() / np.abs(d).sum()
            _, said, mean = _plain_skill(rows, fold, 4, evaluate.chosen(told))
            at = fold == f
            missed[t] += np.abs(y - said)[at, t].sum()
            base[t] += np.abs(y - mean)[at, t].sum()
    assert np.allclose(found.skill, 1 - missed / base, atol=1e-9)


def _two_heads(spark, noise=0.1):
    """Sessions whose level follows their mean, frames that follow their deviation, a target of noise, one that is fixed."""
    rnd = np.random.default_rng(2)
    rows = []
    for s in range(40):
        centre, look = rnd.normal(size=2) * 2, "AB"[s % 2]
        dev = rnd.normal(size=(15, 2))
        dev -= dev.mean(axis=0)
        for i in range(15):
            x = centre + dev[i]
            level = 3 * centre[0] + (5 if look == "B" else 0)
            rows.append((f"{s:03}/{i}", s, x.tolist(), [float(level - 2 * dev[i][1] + noise * rnd.normal()), float(rnd.normal()), 7.0], look))
    return spark.createDataFrame(rows, "file string, session int, x array<double>, y array<double>, look string")


def test_two_heads(spark):
    df = _two_heads(spark).cache()
    p = develop.train(df, "session", "x", "y", ["a", "b", "c"], render="look")
    assert p.renders == ["A", "B"] and list(p.level.gated) == [False, True, True] and list(p.frame.gated) == [False, True, True]
    assert p.skill[0] > 0.8 and p.skill_random[0] > 0.8 and p.level.skill[0] > 0.6 and p.frame.skill[0] > 0.6
    assert p.reasons["c"] == "degenerate" and p.reasons["b"] in ("below the bar", "worse than the constant")
    b, _ = p.level.linear()
    f, _ = p.frame.linear()
    assert abs(b[0, 0] - 3) < 0.5 and abs((b[3, 0] - b[2, 0]) - 5) < 1.5 and abs(f[1, 0] + 2) < 0.3 and abs(f[0, 0]) < 0.3
    out = {r["file"]: r for r in develop.predicted(df, p, "session", "x", facts=p.guards, render="look").collect()}
    truth = {r["file"]: r["y"] for r in df.collect()}
    assert len(out) == 600 and np.mean([abs(out[k]["a"] - v[0]) for k, v in truth.items()]) < 1.5
    assert {r["c"] for r in out.values()} == {7.0} and len({r["b"] for r in out.values()}) == 1
    bold = develop.train(df, "session", "x", "y", ["a", "b", "c"], boldness=1.0)
    assert not bold.renders and bold.skill[1] >= 0
    assert len(spark.createDataFrame(p.rows(), develop.ROWS).collect()) == 6


def test_masks_keep_columns_out(spark):
    df = _two_heads(spark)
    deaf = np.array([[True, True], [True, False], [True, True]])
    p = develop.train(df, "session", "x", "y", ["a", "b", "c"], masks=(deaf, np.array([[True, False]] * 3)))
    assert p.level.weights[1, 1] == 0 and not p.frame.weights[1].any() and p.frame.gated[0]


def test_predictor_guards_and_fallbacks(spark):
    df = _two_heads(spark).filter("session < 4")
    p = develop.Profile(["a"], *[develop.Head(np.array([[1.0], [0.0], *([[2.0], [4.0]] if i == 0 else [])]), np.array([1.0]), np.array([0.0]), np.ones(1), np.array([False]), *[np.ones(1)] * 4) for i in (0, 1)], ["A", "B"], "B", guards={"schema": 1, "dim": 2}, offsets={"a": 0.5})
    for facts in ({"schema": 1}, {"schema": 2, "dim": 2}, {"schema": 1, "dim": 3}):
        with pytest.raises(develop.NotApplicable):
            develop.predicted(df, p, "session", "x", facts=facts)
    facts = {"schema": 1, "dim": 2}
    plain = {r["file"]: (r["a"], r["x"][0]) for r in develop.predicted(df, p, "session", "x", facts=facts).collect()}
    # level 1 + mean + 4 by the default rendering, frame 1 + the rest, offset
    assert all(abs(a - (x + 1 + 4 + 1 + 0.5)) < 1e-3 for a, x in plain.values())
    aimed = {r["file"]: r["a"] for r in develop.predicted(df, p, "session", "x", facts=facts, render="look", override="A").collect()}
    assert all(abs(aimed[k] - plain[k][0] + 2) < 1e-3 for k in aimed)
    lone = develop.predicted(df.limit(1), p, "session", "x", facts=facts, anchors={"a": F.lit(9.0)}).first()
    assert lone["a"] == 9.5
    assert develop.branch({"bw": p}, "color") == "bw" and develop.branch({"bw": p, "color": p}, None) == "color"
    with pytest.raises(develop.NotApplicable):
        develop.branch({}, "color")


def test_session_means(spark):
    rows = [("b", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("c", 1, [9.0]), ("d", 2, [5.0]), ("e", 2, None), ("f", 3, None), ("g", None, [1.0])]
    df = spark.createDataFrame(rows, "file string, session int, x array<double>").repartition(3)
    got = {r["session"]: r["mean"] for r in sessions.means(df, "session", "x").collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0]}
    ctx = {r["file"]: r["context"] for r in sessions.with_context(df, "session", "x").collect()}
    assert ctx["c"] == [9.0] and ctx["a"] == [2.0, 3.0] and ctx["g"] == [1.0] and ctx["f"] is None


def test_context_is_the_same_however_it_is_joined(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    rows = [(f"f{i:03d}", i % 7 if i % 50 else None, rnd.normal(size=3 if i % 31 else 2).tolist() if i % 23 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, session int, x array<double>").withColumns({c: F.lit("own") for c in ("_session", "_mean", "_salt", "mean")})
    state = lambda: {r["file"]: r["context"] for r in sessions.with_context(df, "session", "x").collect()}
    plain = state()
    assert len(plain) == 300 and sessions.with_context(df.limit(0), "session", "x").count() == 0
    for name, value in (("BROADCAST_NUMBERS", 0), ("PLAIN_COLUMNS", 1)):
        monkeypatch.setattr(sessions, name, value)
        other = state()
        assert all((a is None) == (other[k] is None) and (a is None or np.allclose(a, other[k])) for k, a in plain.items())
    long = spark.createDataFrame([(i, i % 5 or None, "pq"[i % 2], float(i)) for i in range(100)], "i int, session int, param string, value double")
    got = {r["i"]: (r["level"], r["residual"]) for r in sessions.levels(long, "session", "param", "value").collect()}
    monkeypatch.setattr(sessions, "BROADCAST_NUMBERS", 4 << 20)
    assert got == {r["i"]: (r["level"], r["residual"]) for r in sessions.levels(long, "session", "param", "value").collect()} and len(got) == 100
    with pytest.raises(ValueError, match="null or NaN"):
        sessions.with_context(spark.createDataFrame([("a", 1, [1.0, None])], "file string, session int, x array<double>"), "session", "x")


def test_many_sessions_get_the_folds_of_few(spark, monkeypatch):
    """The same folds on either side of the bound, by both functions, with sessions of equal size, null, and hot ones."""
    sizes = [(s, s % 5 + 1 + (400 if s == 7 else 0)) for s in range(300)]
    df = spark.createDataFrame([(s or None, i) for s, n in sizes for i in range(n)], "session int, i int").withColumns({c: F.lit(1) for c in ("fold", "_s", "_salt", "_n")})
    few = {r["session"]: r["fold"] for r in folds.dealt(df, "session", 4).collect()}
    assert few == {r["session"]: r["fold"] for r in folds.balanced(df, "session", 4).collect()}
    monkeypatch.setattr(folds, "BROADCAST_ROWS", 10)
    many = folds.dealt(df, "session", 4)
    assert many.count() == df.count() and set(many.columns) == set(df.columns)
    got = many.groupBy("session").agg(F.count_distinct("fold").alias("n"), F.first("fold").alias("fold")).collect()
    assert {r["session"]: r["fold"] for r in got} == few and {r["n"] for r in got} == {1}
    assert {r["session"]: r["fold"] for r in folds.balanced(df, "session", 4).collect()} == few


def test_cycles_are_the_greedy_choice():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        k = int(rnd.integers(1, 7))
        sizes = [(int(n), int(rnd.integers(1, 20))) for n in sorted(set(rnd.integers(1, rnd.choice([4, 30, 900]), 6)), reverse=True)]
        units = [n for n, m in sizes for _ in range(m)]
        cycles, want = folds._cycles(sizes, k), [f for *_, f in folds._greedy(list(enumerate(units)), k)]
        own = [[c for c in cycles if c[0] == n and c[1] <= at][-1] for at, n in enumerate(units)]
        assert [c[2][(at - c[1]) % len(c[2])] for at, c in enumerate(own)] == want


def test_every_rendering_of_enough_frames_counts(spark, monkeypatch):
    df = spark.createDataFrame([(f"r{i % 90}",) for i in range(270)] + [("rare",), (None,)] + [("r5",)] * 3, "look string")
    told, usual = develop._renders(df, "look", 3)
    assert len(told) == 90 and usual == "r5"
    monkeypatch.setattr(develop, "MAX_RENDERS", 89)
    with pytest.raises(ValueError, match="min_renders"):
        develop._renders(df, "look", 3)


def test_clashing_names_pass_through(spark):
    names = ("_cuts", "_r", "_start", "_range", "_n", "_b", "_bucket", "_hash", "fold")
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, session int").withColumns({c: F.lit("own") for c in names})
    for out in (ordered.numbered(df, [F.col("i")]), folds.round_robin(df, "i", 3), folds.dealt(df, "session", 2)):
        rows = out.collect()
        assert len(rows) == 30 and all(r["_cuts"] == r["_start"] == r["_hash"] == "own" for r in rows)


def test_ragged_vectors_raise(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0]), (1, [1.0], [1.0])], "g int, x array<double>, y array<double>")
    with pytest.raises(Exception, match="has not 3 numbers"):
        moments.collect(df, "x", "y", "g")
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0]), (1, [1.0, None], [1.0])], df.schema)
    with pytest.raises(Exception, match="null or NaN number"):
        moments.collect(df, "x", "y", "g")


def test_ties_go_to_the_larger_penalty():
    assert evaluate.chosen({0.1: 0.5, 1.0: 0.5 - 1e-7, 10.0: 0.4}) == 1.0


def _line_world(spark):
    """Twelve players, all pairs, the higher wins."""
    rows = [(0, a * 12 + b, f"p{max(a, b):02}", f"p{min(a, b):02}") for a in range(12) for b in range(a)]
    return spark.createDataFrame(rows, "league int, event_id int, winner string, loser string")


def _stepped(winners, losers, n, steps=800, rate=0.1, decay=0.01):
    """The specified iteration, duel by duel."""
    theta = [0.0] * n
    for _ in range(steps):
        g = [0.0] * n
        for w, l in zip(winners, losers, strict=True):  # noqa: E741
            miss = 1 - 1 / (1 + math.exp(theta[l] - theta[w]))
            g[w] += miss
            g[l] -= miss
        theta = [t + rate * (d - decay * t) for t, d in zip(theta, g, strict=True)]
    mean = sum(theta) / n
    return [t - mean for t in theta]


def test_strengths_of_a_line_world(spark):
    duels = _line_world(spark)
    got = sorted(ranking.bradley_terry(duels, "league").collect(), key=lambda r: r["id"])
    strengths = [r["strength"] for r in got]
    pairs = [(a, b) for a in range(12) for b in range(a)]
    assert np.allclose(strengths, _stepped([a for a, _ in pairs], [b for _, b in pairs], 12), atol=1e-9)
    assert abs(strengths[-1] - 9.72) < 0.005 and strengths == sorted(strengths) and {r["duels"] for r in got} == {11}


def test_many_duels_do_not_overshoot():
    """Where plain steps would diverge, the gradient of the penalised likelihood is 0 at the strengths."""
    rnd = np.random.default_rng(3)
    w, l = rnd.integers(0, 9, 40), rnd.integers(0, 9, 40)  # noqa: E741
    keep = w != l
    w, l, c = w[keep], l[keep], rnd.integers(1, 5000, int(keep.sum())).astype(float)  # noqa: E741
    theta = ranking.strengths(w, l, c, 9)
    assert np.abs(ranking.Likelihood(w, l, c, 9, ranking.DECAY).gradient(theta)).max() < 1e-4
    few = np.ones(len(w))
    assert np.allclose(ranking.strengths(w, l, few, 9), _stepped(w, l, 9), atol=1e-9)


def test_ratings_in_order_with_seeds(spark):
    duels = _line_world(spark).repartition(5)
    seeds = spark.createDataFrame([(0, "p00", 1.0), (0, "new", None), (0, "p01", 0.25)], "league int, id string, score double")
    rating, met = {"p00": 1700.0, "new": 1500.0, "p01": 1400.0}, {}
    for r in sorted(duels.collect(), key=lambda r: r["event_id"]):
        a, b = rating.get(r["winner"], 1500.0), rating.get(r["loser"], 1500.0)
        gain = 32 * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
        rating[r["winner"]], rating[r["loser"]] = a + gain, b - gain
        for i in (r["winner"], r["loser"]):
            met[i] = met.get(i, 0) + 1
    got = {r["id"]: (r["rating"], r["n"]) for r in ranking.elo(duels, "league", "event_id", seeds).collect()}
    assert got.keys() == rating.keys() and all(abs(got[i][0] - v) < 1e-9 and got[i][1] == met.get(i, 0) for i, v in rating.items())
    assert ranking.elo(duels.limit(0), "league", "event_id").count() == 0


def test_next_pair_is_little_seen_and_near(spark):
    rows = [(0, f"p{i}", 1500.0 + 10 * i, 0 if i in (2, 5) else 50) for i in range(8)] + [(1, "alone", 1500.0, 3)]
    ratings = spark.createDataFrame(rows, "league int, id string, rating double, n long")
    seen = set()
    for turn in range(8):
        (pair,) = ranking.next_pair(ratings, "league", turn).collect()
        seen.add(pair["a"])
        assert pair["b"] == {"p2": "p1", "p5": "p4"}[pair["a"]]
    assert seen == {"p2", "p5"}


def test_the_pool_is_the_least_duelled_quarter(spark):
    """Ties at its border go by id; leagues of every size."""
    rnd = np.random.default_rng(12)
    rows = [(g, f"p{i:03d}", float(rnd.normal()), int(rnd.integers(0, 3)) or None) for g in range(4) for i in range((2, 5, 40, 101)[g])]
    ratings = spark.createDataFrame(rows, "league int, id string, rating double, n long")
    want = {g: {r[1] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3] or 0, r[1]))[: max(1, sum(r[0] == g for r in rows) // 4)]} for g in range(4)}
    got = {}
    for turn in range(4):
        for r in ranking.next_pair(ratings, "league", turn).collect():
            got.setdefault(r["league"], set()).add(r["a"])
            a = next(x for x in rows if x[:2] == (r["league"], r["a"]))
            assert r["b"] == min((abs(x[2] - a[2]), x[1]) for x in rows if x[0] == a[0] and x[1] != a[1])[1]
    assert got.keys() == want.keys() and all(got[g] <= want[g] for g in want)


def test_large_leagues_are_fitted_by_joins_and_sums(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    skill = rnd.normal(size=12)
    duels = [(g, f"p{(a if won else b):02d}", f"p{(b if won else a):02d}") for g in (0, 1) for a, b in rnd.integers(0, 12, (300 if g else 20, 2)) if a != b for won in [rnd.random() < 1 / (1 + np.exp(skill[b] - skill[a]))]]
    df = spark.createDataFrame(duels, "league int, winner string, loser string")
    one = {(r["league"], r["id"]): r for r in ranking.bradley_terry(df, "league").collect()}
    monkeypatch.setattr(ranking, "MAX_PAIRS", 40)
    monkeypatch.setattr(ranking, "SETTLED", 3e-3)
    both = {(r["league"], r["id"]): r for r in ranking.bradley_terry(df, "league").collect()}
    assert one.keys() == both.keys() and all(one[k]["duels"] == both[k]["duels"] for k in one)
    assert all(abs(one[k]["strength"] - both[k]["strength"]) < 1e-9 for k in one if k[0] == 0)
    w, l, n = zip(*[(int(a[1:]), int(b[1:]), 1.0) for g, a, b in duels if g == 1], strict=True)
    best = ranking.Likelihood(np.array(w), np.array(l), np.array(n), 12, ranking.DECAY).maximum()
    assert all(abs(both[1, f"p{i:02d}"]["strength"] - (best - best.mean())[i]) < 0.1 for i in range(12))


def test_rank_profile(spark):
    """Photos on a line in one direction of their vectors: held-out duels are foretold, stars follow the scores."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(120, 6))
    worth = x @ np.array([2.0, -1, 0, 0, 0, 0.5])
    photos = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)], "id int, x array<double>")
    pairs = [tuple(map(int, rnd.choice(120, 2, replace=False))) for _ in range(600)] + [(500, 1)]
    duels = spark.createDataFrame([(k, *sorted(p, key=lambda i: -worth[i] if i < 120 else 0)) for k, p in enumerate(pairs)], "duel int, winner int, loser int")
    p = ranking.rank_profile(photos, duels)
    assert p.duels == 600 and p.photos <= 120 and p.accuracy > 0.9 and p.spread > 0
    stars = {r["id"]: r["stars"] for r in photos.select("id", p.stars(F.col("x")).alias("stars")).collect()}
    top = sorted(range(120), key=lambda i: -worth[i])
    assert np.mean([stars[i] for i in top[:10]]) > 4.5 and np.mean([stars[i] for i in top[-10:]]) < 0.6
    assert 8 <= sum(s == 5 for s in stars.values()) <= 16
    assert ranking.rank_profile(photos, duels.limit(12)).accuracy is None
    with pytest.raises(ValueError, match="a profile needs 10"):
        ranking.rank_profile(photos, duels.limit(5))


def test_rows_are_numbered_in_parts_that_hold_few(spark, monkeypatch):
    """Folds of rows are those of one numbering by hash, and tasks order as many rows as PART_ROWS says, not a share of
    all; folds of many sessions are the same broadcast or joined."""
    monkeypatch.setattr(folds, "PART_ROWS", 50)
    names = [f"/cat/{i}" for i in range(8000)]
    df = spark.createDataFrame([(f, i % 90) for i, f in enumerate(names)], "file string, session int").repartition(3)
    out = folds.round_robin(df, "file", 5).withColumn("task", F.spark_partition_id()).collect()
    digest = {f: hashlib.md5(f.encode()).hexdigest() for f in names}
    want = {f: i % 5 for i, f in enumerate(sorted(names, key=lambda f: (int(digest[f][:2], 16) % 64, digest[f])))}
    assert {r["file"]: r["fold"] for r in out} == want
    assert max(Counter(r["task"] for r in out).values()) <= 4 * 50
    few = {r["session"]: r["fold"] for r in folds.dealt(df, "session", 4).collect()}
    monkeypatch.setattr(folds, "BROADCAST_ROWS", 10)
    for most in (1_000, 10):
        monkeypatch.setattr(folds, "BROADCAST_FOLDS", most)
        assert {r["session"]: r["fold"] for r in folds.dealt(df, "session", 4).collect()} == few


def test_anchor_finds_a_slope_and_rejects_noise(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=400)
    z = (x - x.mean()) / x.std()
    slope, noise = np.maximum(z - 0.5, 0) * 4 + rnd.normal(size=400) * 0.05, rnd.normal(size=400)
    rows = [(p, "f", float(a), float(b), f"s{i % 12}") for p, y in (("slope", slope), ("noise", noise)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [("few", "f", 1.0 * i, 1.0 * i, f"s{i}") for i in range(50)] + [("flat", "f", 1.0, 1.0 * i, f"s{i % 9}") for i in range(90)]
    got = {r["param"]: r for r in anchors.fits(spark.createDataFrame(rows, "param string, feature string, x double, y double, session string"), shuffles=4).collect()}
    assert set(got) == {"slope", "noise"}
    fit = got["slope"]
    assert fit["n"] == 400 and fit["kept"] and abs(fit["above"] - 4) < 0.4 and abs(fit["width"] - 0.5) <= 0.15 and fit["mean_skill"] > 0.8
    assert not got["noise"]["kept"]


def test_anchors_read_their_rows_a_few_times(spark):
    """Two passes tell a pair's mean and tail, one packs its rows with the folds of all deals; errors over held-out rows
    are those of plain refits."""
    rnd = np.random.default_rng(6)
    x, read = rnd.normal(size=300), spark.sparkContext.accumulator(0)
    rows = [("p", "f", float(a), float(max(a, 0) * 2 + 0.3 * rnd.normal()), f"s{i % 25}") for i, a in enumerate(x)]
    kind = "param string, feature string, x double, y double, session string"

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = anchors.fits(spark.createDataFrame(rows, kind).mapInArrow(counted, kind), shuffles=20).collect()[0]
    assert got["n"] == 300 and got["kept"] and read.value <= 4 * 300
    fold = {r["session"]: r["f"] for r in spark.createDataFrame(rows, kind).select("session", F.array(*[F.pmod(F.xxhash64("session", F.lit(k)), F.lit(5)) for k in range(20)]).alias("f")).distinct().collect()}
    z, y = (x - x.mean()) / x.std(), np.array([r[3] for r in rows])
    folds_ = np.array([fold[r[4]] for r in rows])

    def fit(at, w):
        a = np.column_stack((np.ones(at.sum()), np.maximum(z[at] - w, 0), np.minimum(z[at] + w, 0)))
        return np.linalg.lstsq(a, y[at], rcond=None)[0]

    def off(at, w, b):
        return np.abs(y[at] - b[0] - b[1] * np.maximum(z[at] - w, 0) - b[2] * np.minimum(z[at] + w, 0)).sum()

    skills = []
    for s in range(20):
        f, error = folds_[:, s], 0.0
        for out in set(f):
            inner = {w: sum(off(f == g, w, fit((f != g) & (f != out), w)) for g in set(f) - {out}) for w in anchors.WIDTHS}
            w = anchors._chosen(inner)
            error += off(f == out, w, fit(f != out, w))
        skills.append(1 - error / np.abs(y - y.mean()).sum())
    assert abs(got["mean_skill"] - np.mean(skills)) < 1e-6


def test_anchor_sums_solve_like_least_squares():
    rnd = np.random.default_rng(5)
    x, y = rnd.normal(size=80), rnd.normal(size=80)
    up, down = np.maximum(x - 0.2, 0), np.minimum(x + 0.2, 0)
    s = np.array([80, up.sum(), down.sum(), (up * up).sum(), (down * down).sum(), y.sum(), (up * y).sum(), (down * y).sum()])
    assert np.allclose(anchors.solved(s), np.linalg.lstsq(np.column_stack((np.ones(80), up, down)), y, rcond=None)[0], atol=1e-6)


def test_rasters():
    flat, board = np.full((32, 32), 9), np.indices((32, 32)).sum(axis=0) % 2 * 255
    assert raster.laplacian_variance(flat) == 0 and raster.laplacian_variance(board) > 1e5
    assert raster.focus_tiles(board).shape == (2, 2)
    with pytest.raises(ValueError):
        raster.laplacian_variance(np.zeros((2, 5)))
    assert raster.polygon(np.array([(0, 0), (4, 0), (4, 4), (0, 4)]), 8).sum() == 16


SCHEMA = StructType([StructField("file", StringType()), StructField("x", ArrayType(DoubleType()))])


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], SCHEMA)
    path = str(tmp_path / "set")
    jsonl.write_dataset(rows, {"model": "m", "dim": 1}, path)
    back, meta = jsonl.dataset(spark, path, SCHEMA)
    assert sorted(map(tuple, back.collect())) == [("a", [1.0]), ("b", [2.0])] and meta == {"model": "m", "dim": 1}
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps({"file": "a", "x": [1.0]}) + "\n{broken\n")
    assert jsonl.lenient(spark, str(bad), SCHEMA).count() == 1
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        jsonl.strict(spark, str(bad), SCHEMA).collect()
    with pytest.raises(jsonl.BadDataset):
        jsonl.merge_guard({"model": "m", "dim": 1}, {"model": "n", "dim": 1})


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 2, i, f"p{i * 7 % 5}", f"p{(i * 7 + 1 + i % 3) % 5}") for i in range(60)]
    duels = spark.createDataFrame([r for r in rows if r[2] != r[3]], "league long, event_id long, winner string, loser string")
    duels.filter("event_id < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(duels.schema).parquet(str(tmp_path / "in"))
    query = online.elo_stream(stream).writeStream.format("memory").queryName("ratings").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    first = {(r["league"], r["id"]): r["rating"] for r in spark.table("ratings").collect()}
    duels.filter("event_id >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    seen = dict(first)
    for r in spark.table("ratings").collect():
        seen[(r["league"], r["id"])] = r["rating"]
    batch = {(r["league"], r["id"]): r["rating"] for r in ranking.elo(duels, "league", "event_id").collect()}
    assert seen.keys() == batch.keys() and all(math.isclose(seen[k], batch[k], rel_tol=1e-9) for k in batch)


def test_upserts_survive_replays(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "k string, at int, v int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for n in (1, 2):  # the second time from no checkpoint: the same batches again
        online.upsert_batches(stream, str(tmp_path / "log"), ["k"], ["at"], str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in online.upserted(spark, str(tmp_path / "log"), ["k"], ["at"]).collect()) == [("a", 20), ("b", 30)]


def test_plans_tell_all_mistakes(spark):
    from tastegrid.plans import steps

    ops = {"keep": lambda df, least: df.filter(F.col("id") >= int(least)), "fail": lambda df: df.select("none")}
    with pytest.raises(steps.BadPlan, match="version.*twice.*no transform|version.*no transform.*twice"):
        steps.resolved({"version": 1, "steps": [{"id": "a", "run": "keep"}, {"id": "a", "run": "other"}]}, ops)
    plan = steps.resolved({"version": 2, "vars": {"n": 3}, "defaults": {"keep": {"least": 1}}, "steps": [{"run": "keep"}, {"run": "keep", "with": {"least": "${n}"}}, {"run": "fail", "continue_on_error": True}, {"run": "keep", "with": {"least": 9}, "enabled": False}]}, ops)
    df, told = steps.run(spark.range(5), plan, ops)
    assert df.count() == 2 and told["step4"] == "skipped" and told["step3"].startswith("AnalysisException")
    config = {"version": 2, "vars": {"a": "x", "b": "${a}y"}, "steps": [{"run": "keep", "with": {"p": "${b}/${env:HOME_DIR}", "q": "$${b}", "r": 5}}]}
    assert steps.resolved(config, ops, environment={"HOME_DIR": "h"})[0].options == {"p": "xy/h", "q": "${b}", "r": 5}
    assert steps.resolved(config, ops, {"a": "z"}, {"HOME_DIR": "h"})[0].options["p"] == "zy/h"
    with pytest.raises(steps.BadPlan, match="unknown environment variable HOME_DIR"):
        steps.resolved(config, ops)
    with pytest.raises(steps.BadPlan, match="overrides: unknown variable c"):
        steps.resolved(config, ops, {"c": 1}, {"HOME_DIR": "h"})


GARDEN = language.Lexicon(
    terms={"hedge": ("object", "hedge"), "hedges": ("object", "hedge"), "rose bed": ("object", "bed"), "bed": ("object", "bed"), "trim": ("act", "cut"), "cut back": ("act", "cut"), "let grow": ("act", "grow"), "don t": ("negation", "no"), "never": ("negation", "no")},
    rules=(language.Rule("hedge", "cut", "low-hedge", "hedge", -1), language.Rule("hedge", "grow", "tall-hedge", "hedge", 1, priority=1), language.Rule("hedge", "cut", "tall-hedge", "hedge", 1, negated=True), language.Rule("bed", None, "weed-bed", "bed", 1)),
    breaks=("then",),
)


def test_requests_by_a_lexicon_of_the_callers(spark):
    cases = {
        "Trim the hedge, rose bed": (["low-hedge", "weed-bed"], []),
        "Don't trim the hedges": (["tall-hedge"], []),
        "never the bed": ([], ["never the bed"]),
        "let grow or trim the hedge": (["tall-hedge"], []),
        "cut the hedge back": ([], ["cut the hedge back"]),
        "let the hedge be then cut back hedges": (["low-hedge"], ["let the hedge be"]),
        "trim the hedge; let grow the hedge": (["low-hedge", "tall-hedge"], []),
        "Plus de lumière": ([], ["plus de lumiere"]),
        "thenhedge trim": ([], ["thenhedge trim"]),
        "": ([], []),
        None: ([], []),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").withColumn("r", language.requested(F.col("t"), GARDEN))
    rows = df.select("i", "r", language.contradicted(F.col("r")["intents"], GARDEN).alias("bad")).collect()
    got = {r["i"]: (r["r"]["intents"], r["r"]["unmatched"]) for r in rows}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert GARDEN.conflicts == [("tall-hedge", "low-hedge")] and [r["i"] for r in rows if r["bad"]] == [6]
    with pytest.raises(ValueError, match="no term names"):
        language.Lexicon({}, (language.Rule("x", None, "y", "z", 1),))
    with pytest.raises(ValueError, match="two ways"):
        language.Lexicon({"x": ("object", "x")}, (language.Rule("x", None, "y", "z", 1), language.Rule("x", "a", "y", "z", -1)))


def test_keywords_of_scenes(spark):
    zoo = language.Scenes({"pond": frozenset(("pond", "ducks")), "feather": frozenset(("feather",))}, {"inside": frozenset(("cage",)), "outside": frozenset(("lawn", "path"))}, frozenset(("keeper",)), frozenset(("beak",)), frozenset(("posing",)), "face", (("mallard", "duck"),))
    rows = [
        (0, "Ducks on the pond, a lawn and a cage", [("Keeper", 0.1, 0.1, 0.7, 0.9), ("beak", 0.2, 0.3, 0.6, 0.8)]),
        (1, "a hat with a feather", [("keeper", 0.0, 0.0, 0.9, 0.9), ("feather", 0.2, 0.2, 0.4, 0.4)]),
        (2, "feather on the path", [("feather", 0.2, 0.2, 0.4, 0.4), ("bee", 0.2, 0.2, 0.21, 0.21), ("Mallard", 0.0, 0.0, 0.5, 0.5)]),
        (3, None, None),
        (4, "keeper, posing", [("keeper", 0.0, 0.0, 0.2, 0.2), ("face", 0.5, 0.5, 0.6, 0.6)]),
    ]
    df = spark.createDataFrame(rows, "i int, c string, o array<struct<label:string,x0:double,y0:double,x1:double,y1:double>>")
    got = {r["i"]: r["k"] for r in df.select("i", language.keywords(F.col("c"), F.col("o"), zoo).alias("k")).collect()}
    assert got == {0: ["portrait", "pond", "keeper"], 1: ["portrait", "keeper"], 2: ["feather", "outside", "duck"], 3: [], 4: ["portrait", "keeper"]}


def test_library_judgements(spark):
    df = spark.createDataFrame([(1, {"tint": 0.0, "temp": 5500.0}, None, ["mixer_red"]), (2, {"tint": 3.0}, "color", ["mixer_red"]), (3, {"temp": 5600.0, "x": None}, None, ["exposure"]), (4, None, "bw", None)], "i int, v map<string,double>, f string, k array<string>")
    got = {r["i"]: (r["e"], r["t"]) for r in df.select("i", library.edited(F.col("v"), {"temp": 5500.0}).alias("e"), library.treatment(F.col("f"), F.col("k"), ("mixer_",)).alias("t")).collect()}
    assert got == {1: (False, "bw"), 2: (True, "color"), 3: (True, "color"), 4: (False, "bw")}
    assert [one(spark, library.verdict(F.lit(a), F.lit(b), 10, 20)) for a, b in ((10, 0), (9, 20), (9, 19))] == ["sharp", "rescued", "soft"]
    cuts = ((0.2, 1), (0.5, 3), (0.8, 5))
    assert [one(spark, library.stars(F.lit(m), F.lit(f), cuts, 1, 2, 2)) for m, f in ((0.9, 9), (0.5, 9), (0.1, 9), (0.9, 1.5), (0.9, 0.5))] == [5, 3, 0, 2, 0]


def test_library_merges(spark):
    tags = F.array(F.lit("color:blue"), F.lit("user:a"))
    assert one(spark, library.merged_tags(tags, {"color:": F.lit("red")}, F.array(F.lit("USER:B"), F.lit("user:a")))) == ["color:red", "user:a", "user:b"]
    assert one(spark, library.merged_tags(tags, {"color:": F.lit(None).cast("string")}, F.lit(None).cast("array<string>"))) == ["user:a"]
    template, kept = F.create_map(F.lit("a"), F.lit("t"), F.lit("b"), F.lit("t")), F.create_map(F.lit("a"), F.lit("mine"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("x"))
    assert one(spark, library.preserved(template, kept)) == {"a": "mine", "b": "t", "c": "x"}
    base = spark.createDataFrame([(1, 3, "x"), (2, 4, "y"), (3, 5, "z")], "k int, stars int, label string")
    reports = spark.createDataFrame([(1, 5, None, "x", None), (2, 4, 4, "new", "y")], "k int, stars int, sent_stars int, label string, sent_label string")
    assert sorted(map(tuple, library.reconciled(base, reports, "k", ["stars", "label"]).collect())) == [(1, 5, "x", True), (2, 4, "new", True), (3, 5, "z", False)]
    files = spark.createDataFrame([(1, 10, 5), (2, 20, 5)], "f int, size int, mtime int")
    results = spark.createDataFrame([(1, 10, 5, "ok"), (2, 20, 6, "old")], "f int, size int, mtime int, v string")
    assert sorted((r["f"], r["v"]) for r in library.valid_results(files, results, "f", ["size", "mtime"], ["v"]).collect()) == [(1, "ok"), (2, None)]


def test_unique_names(spark):
    files = spark.createDataFrame([(1, "x"), (2, "X"), (3, "x"), (4, "x_2"), (5, "y"), (6, "x_2"), (7, "z")], "i int, name string")
    got = {r["i"]: r["name"] for r in library.unique_names(files, "name", [F.col("i")], ".raw").collect()}
    assert got == {1: "x.raw", 2: "X_3.raw", 3: "x_4.raw", 4: "x_2.raw", 5: "y.raw", 6: "x_2_2.raw", 7: "z.raw"} and len({v.lower() for v in got.values()}) == 7
    taken = spark.createDataFrame([("y.raw",), ("Z_2.RAW",), ("z.raw",)], "name string")
    got = {r["i"]: r["name"] for r in library.unique_names(files, "name", [F.col("i")], ".raw", taken).collect()}
    assert got[5] == "y_2.raw" and got[7] == "z_3.raw"


def test_numbering_neighbours_and_medians(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    v = np.concatenate((rnd.normal(size=900), np.zeros(100)))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").repartition(7)
    order = sorted(range(1000), key=lambda i: (v[i], i))
    got = {r["i"]: r["place"] for r in ordered.numbered(df, [F.col("v"), F.col("i")]).collect()}
    assert [got[i] for i in order] == list(range(1, 1001))
    near = {r["i"]: [r[k] and r[k]["id"] for k in ("below", "level", "above")] for r in ordered.neighbours(df, "i", "v").collect()}
    values = sorted({x: 0 for x in v})
    of = {x: [i for i in range(1000) if v[i] == x] for x in values}
    for i in range(1000):
        at = values.index(v[i])
        assert near[i] == [of[values[at - 1]][0] if at else None, next((j for j in of[v[i]] if j != i), None), of[values[at + 1]][0] if at + 1 < len(values) else None]
    tied = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 9.0), (5, None)], "i int, v double")
    assert [[r[k] and r[k]["id"] for k in ("below", "level", "above")] for r in ordered.neighbours(tied, "i", "v").orderBy("i").collect()] == [[None, 2, 4], [None, 1, 4], [None, 1, 4], [1, None, None], [None] * 3]
    for rows in (50_000, 20):
        monkeypatch.setattr(ordered, "BRACKET_ROWS", rows)
        assert ordered.median(df, "v") == float(np.median(v)) and ordered.median(df.filter("i < 899"), "v") == float(np.median(v[:899]))
    assert ordered.median(df.limit(0), "v") is None and ordered.numbered(df.limit(0), [F.col("i")]).count() == 0


def test_top_keywords(spark):
    frames = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "i int, v array<double>")
    terms = spark.createDataFrame([("b", [0.5, 0.0]), ("a", [0.5, 0.0]), ("c", [0.9, 0.1]), ("d", [0.0, 1.0])], "term string, vector array<double>")
    assert [(r["i"], r["rank"], r["label"], r["score"]) for r in keywords.top(frames, terms, "i", "v", k=2).orderBy("i", "rank").collect()] == [(1, 1, "c", 0.9), (1, 2, "a", 0.5)]
    assert keywords.top(frames, terms.limit(0), "i", "v").count() == 0


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 1.0), (1, 9.0, 3.0), (2, 4.0, 2.0)], "g int, v double, w double")
    assert {r["g"]: r["percentile"] for r in feedback.weighted_percentile(df, "g", "v", F.col("w"), 0.4).collect()} == {1: 5.0, 2: 4.0}


def test_photometric_figures():
    """Each figure against its definition, pixel by pixel."""
    import colorsys

    rnd = np.random.default_rng(11)
    image = rnd.integers(0, 256, (9, 11, 3))
    image[:2] = [[[252, 251, 255]], [[1, 2, 0]]]
    got = dict(zip(raster.FEATURES, raster.photometric(image), strict=True))
    assert len(raster.FEATURES) == 50
    pixels = [tuple(map(int, p)) for p in image.reshape(-1, 3)]
    n, luma = len(pixels), [0.2126 * r + 0.7152 * g + 0.0722 * b for r, g, b in (tuple(map(int, p)) for p in image.reshape(-1, 3))]
    levels = [min(255, int(v)) for v in luma]
    hsv = [colorsys.rgb_to_hsv(*(c / 255 for c in p)) for p in pixels]
    rank = lambda values, q: next(i for i in range(256) if sum(v <= i for v in values) >= len(values) * q)
    plane = np.array(luma).reshape(9, 11)
    coarse = [[plane[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range(5)] for y in range(4)]
    lap = lambda p: np.mean([abs(4 * p[y][x] - p[y - 1][x] - p[y + 1][x] - p[y][x - 1] - p[y][x + 1]) for y in range(1, len(p) - 1) for x in range(1, len(p[0]) - 1)]) / 1020
    want = {
        "luma_mean": np.mean(levels) / 255, "luma_median": rank(levels, 0.5) / 255, "luma_std": np.std(levels) / 255, "luma_hist_3": sum(48 <= v < 64 for v in levels) / n, "clip_high": sum(min(p) >= 250 for p in pixels) / n,
        "clip_low": sum(max(p) <= 4 for p in pixels) / n, "green_mean": np.mean([p[1] for p in pixels]) / 255, "blue_std": np.std([p[2] for p in pixels]) / 255, "red_green": sum(p[0] for p in pixels) / sum(p[1] for p in pixels),
        "saturation_mean": np.mean([s for _, s, _ in hsv]), "saturation_std": np.std([s for _, s, _ in hsv]), "value_mean": np.mean([v for *_, v in hsv]), "hue_hist_5": sum(s for h, s, _ in hsv if int(h * 12) == 5) / n,
        "luma_p01": rank(levels, 0.01) / 255, "luma_p99": rank(levels, 0.99) / 255, "shadow_floor": rank([int(v) for row in coarse for v in row], 0.05) / 255, "detail_fine": lap(plane.tolist()), "detail_coarse": lap(coarse), "dark_channel": np.mean([min(p) for p in pixels]) / 255,
    }
    assert all(abs(got[k] - v) < 2e-6 for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) >= 2e-6}
    assert raster.photometric(np.zeros((1, 1, 3), dtype=int))[0] == 0


def test_regional_figures():
    pixels = np.full((16, 16), 100)
    pixels[:8, :8] = 255
    got = raster.regional(pixels, np.array([[9.0, 1.0], [4.0, 0.0]]))
    assert got["subject_mean"] == 255 and got["subject_high"] == 1 and got["whole_high"] == 0.25 and got["whole_p05"] == 100


def test_online_ratings_start_from_scores():
    """The state function alone: seeds for new players, the state's ratings for known ones."""
    import pandas as pd

    class State:
        exists, get = True, (["old"], [1800.0])

        def update(self, value):
            self.value = value

    state = State()
    duels = pd.DataFrame({"event_id": [2, 1], "winner": ["new", "old"], "loser": ["old", "new"], "winner_score": [0.0, 0.9], "loser_score": [0.0, 1.0]})
    (out,) = online._play((7,), iter([duels]), state)
    first = 32 * (1 - ranking.expected(1800.0, 1700.0))
    old, new = 1800 + first, 1700 - first
    second = 32 * (1 - ranking.expected(new, old))
    assert dict(zip(out["id"], out["rating"], strict=True)) == {"new": new + second, "old": old - second} == dict(zip(*state.value, strict=True))


def test_new_rows_stay_beside_existing_keys_that_they_meet(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(30, 1.0, "a"), (500_030, 2.0, "b"), (500_031, 3.0, "c")]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["upsert_photos"](spark, str(tmp_path)).collect())
    assert got == [(30, 2.0, "a"), (500_030, 2.0, "b"), (500_030, 2.0, "new"), (500_031, 4.0, "c")]


def test_numbers_are_of_one_computation(spark):
    import random

    drawn = F.udf(lambda i: random.random(), "double").asNondeterministic()
    df = spark.range(500).repartition(4).select("id", drawn("id").alias("v"))
    rows = ordered.numbered(df, [F.col("v"), F.col("id")]).collect()
    assert [r["place"] for r in sorted(rows, key=lambda r: (r["v"], r["id"]))] == list(range(1, 501))


def test_facts_beside_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), (None, 2), ("d", 3)], "p string, v int")
    facts = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y"), ("c", 3.0, "z")], "p string, m double, kind string")
    plain = sorted(map(tuple, rows.join(facts, "p").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = sessions.beside(rows, facts, "p")
        assert "BroadcastHashJoin" in few._jdf.queryExecution().toString() and sorted(map(tuple, few.collect())) == plain
        monkeypatch.setattr(sessions, "FEW_FACTS", 2)
        many = sessions.beside(rows, facts, "p")
        assert many.columns == ["p", "v", "m", "kind"] and sorted(map(tuple, many.collect())) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["rr_edited", "rr_roundtrip", "emit_settings", "polygon_mask"])
def test_long_work_on_small_tables_is_dealt_over_all_tasks(spark, tmp_path, name):
    import __spark_entry__ as entry

    rows = [(i, f"part {i}", i % 50, 900.0 + i) for i in range(1, 61)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = entry.queries()[name](spark, str(tmp_path)).select("p_partkey", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["p_partkey"] for r in out}) == 60 and len({r["task"] for r in out}) >= 12


def test_short_vectors_are_averaged_without_python(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", [3.0, 4.0]), (1, "c", [9.0]), (2, "a", None), (None, "a", [1.0])], "session int, file string, x array<double>")
    found = sessions.means(df, "session", "x")
    assert [tuple(r) for r in found.collect()] == [(1, [2.0, 3.0])] and "MapInArrow" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in sessions._summed_means(df, "session", "x", "file").collect()] == [(1, [2.0, 3.0])]


def test_clusters_are_sought_in_few_parts(spark, monkeypatch):
    from types import SimpleNamespace

    from tastegrid.operators import structure

    parts = []

    def fit(rows):
        parts.append(rows.rdd.getNumPartitions())
        return SimpleNamespace(summary=SimpleNamespace(trainingCost=float(rows.count())))

    monkeypatch.setattr(structure, "KMeans", lambda **_: SimpleNamespace(fit=fit))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(200).select(F.col("id").cast("int").alias("id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
        assert [k for k, _, _ in structure.structure(df, "id", "v", nulls=1)] == [2, 3, 4]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) == 6 and max(parts) <= spark.sparkContext.defaultParallelism
