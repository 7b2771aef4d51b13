"""Looks, their solvers and intents, against numpy and against looks that were planted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.functions import look
from tastegrid.operators import folds, looks, tone

NEUTRAL = np.zeros(6)
TONE = tone.KIND


def _frames(n=30, seed=1):
    rnd = np.random.default_rng(seed)
    return [(i, (rnd.normal(size=64) * 2.2 - 5).tolist(), rnd.integers(0, 4, 64).astype(float).tolist()) for i in range(n)]


def _df(spark, rows):
    return spark.createDataFrame(rows, "id int, stops array<double>, weights array<double>").withColumn("anchor", look.white(F.col("stops"), F.col("weights")))


def _tone(values):
    return F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(look.CONTROLS, values, strict=True)])


def _plain_look(stops, weights, anchor, t):
    """One value after the other."""
    e, c, h, s, w, b = t
    smooth = lambda a, z, x: (lambda u: u * u * (3 - 2 * u))(min(1, max(0, (x - a) / (z - a))))
    out = []
    for x, n in zip(stops, weights, strict=True):
        lifted, white = x + e, anchor + e
        moved = h * 0.55 * min(max(lifted - (white - 3.2), 0), 4) + s * 0.55 * min(max(white - 4.6 - lifted, 0), 4) + w * 1.1 * smooth(white - 2.6, white + 0.2, lifted) + b * 1.1 * (1 - smooth(white - 7.5, white - 3.2, lifted))
        grey = white - 2.4739
        y = min(1, 2 ** (grey + (lifted + moved - grey) * (1 + c * 0.45)))
        v = y * 12.92 if y <= 0.0031308 else 1.055 * y ** (1 / 2.4) - 0.055
        if n > 0:
            out.append((v + (v * v * (3 - 2 * v) - v) * 0.3, n))
    out.sort()
    total, found = sum(n for _, n in out), []
    for p in look.PERCENTILES:
        seen = 0.0
        for v, n in out:
            seen += n
            if seen >= p * total - 1e-12:
                break
        found.append(v)
    return found


def test_looks_as_done_plainly(spark):
    rows = _frames()
    for t in (NEUTRAL, (1.2, -1.0, 0.8, 1.0, -0.5, 0.7), (-2.0, 0.6, -1.0, -1.0, 1.0, -1.0)):
        got = {r["id"]: r for r in _df(spark, rows).select("id", "anchor", look.look_of(F.col("stops"), F.col("weights"), F.col("anchor"), _tone(t)).alias("l")).collect()}
        for i, s, w in rows:
            want = _plain_look(s, w, got[i]["anchor"], t)
            assert np.allclose(got[i]["l"], want, atol=1e-12)
            assert np.allclose(tone.looks(tone.displayed(np.array(s), got[i]["anchor"], np.array([t], dtype=float)), np.array(w))[0], want, atol=1e-12)


def test_odd_histograms(spark):
    df = _df(spark, [(1, [], []), (2, [-3.0], [0.0]), (3, None, None), (4, [-3.0], [2.0])]).withColumns({"prior": _tone(NEUTRAL), "wanted": F.array(*[F.lit(0.5)] * 9), "regions": F.create_map().cast("map<string,array<double>>"), "limits": F.array(F.struct(F.lit(None).cast("string").alias("region"), F.lit(4).alias("place"), F.lit(0.5).alias("low"), F.lit(None).cast("double").alias("high"))), "free": F.lit(None).cast("array<string>")})
    for run in (tone.solved, tone.bounded):
        got = {r["id"]: r for r in run(df).collect()}
        assert all(list(got[i]["tone"]) == [0.0] * 6 for i in (1, 2, 3)) and any(got[4]["tone"])
        assert run(df.limit(0)).count() == 0


def test_planted_looks_are_found_again(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for i, s, w in _frames(12, 3):
        t = rnd.uniform(-0.6, 0.6, 6)
        anchor = float(tone.looks(np.array([s]), np.array(w))[0, -1])
        rows.append((i, s, w, anchor, None, tone.looks(tone.displayed(np.array(s), anchor, t[None]), np.array(w))[0].tolist()))
    df = spark.createDataFrame(rows, f"id int, stops array<double>, weights array<double>, anchor double, prior {TONE}, wanted array<double>")
    left = [r["left"] for r in tone.solved(df, stiffness=0.05).collect()]
    assert max(left) < 2.5 and sum(left) / len(left) < 0.8


def test_five_kinds_of_bounds(spark):
    """Percentiles from below and above, the spread, and parts of the frame; met bounds move nothing, a bound that cannot
    be met is told."""
    rows = _frames(6, 5)
    limit = lambda region, place, low, high: (region, place, low, high)
    cases = {"none": [limit(None, 4, 0.0, 1.0)], "low": [limit(None, 1, 0.1, None)], "high": [limit(None, 8, None, 0.6)], "spread": [limit(None, None, 0.25, 0.4)], "part": [limit("sky", 4, 0.2, None)], "absent": [limit("sea", 4, 0.9, None)], "never": [limit(None, 1, 0.9, None), limit(None, 8, None, 0.1)]}
    sky = [1.0] * 20 + [0.0] * 44
    data = [(name, i, s, w, {"sky": sky}, c, None if name != "part" else ["exposure"]) for name, c in cases.items() for i, s, w in rows]
    df = spark.createDataFrame(data, f"name string, id int, stops array<double>, weights array<double>, regions map<string,array<double>>, limits {tone.LIMITS}, free array<string>")
    df = df.withColumns({"anchor": look.white(F.col("stops"), F.col("weights")), "prior": F.lit(None).cast(TONE)})
    got = {}
    for r in tone.bounded(df).collect():
        got.setdefault(r["name"], []).append(r)
    assert all(not any(r["tone"]) and r["left"] == 0 for name in ("none", "absent") for r in got[name])
    for name in ("low", "high", "spread", "part"):
        assert all(r["left"] < 30 for r in got[name]) and any(any(r["tone"]) for r in got[name]), [r["left"] for r in got[name]]
    assert all(not any(list(r["tone"])[1:]) for r in got["part"]) and all(r["left"] > 100 for r in got["never"])
    # no move of one control alone does with less
    for r in got["low"]:
        c = dict(zip(look.CONTROLS, r["tone"], strict=True))
        if r["left"] == 0 and any(c.values()):
            less = np.array([v * 0.9 for v in r["tone"]])
            s, w = np.array(r["stops"]), np.array(r["weights"])
            assert tone.looks(tone.displayed(s, r["anchor"], less[None]), w)[0, 1] < 0.1 + 1e-3


def test_intents(spark):
    assert tone.conflicts() == [("open-shadows", "keep-shadows-deep"), ("soft-contrast", "punchy-contrast")]
    with pytest.raises(ValueError, match="opposite"):
        tone.resolved(["soft-contrast", "Punchy-contrast "])
    with pytest.raises(ValueError, match="unknown"):
        tone.resolved(["brighter"])
    df = _df(spark, _frames(8, 2)).withColumns({"regions": F.create_map(F.lit("sky"), F.transform("weights", lambda w, i: F.when(i < 20, w).otherwise(0.0))), "m": F.create_map(F.lit("Exposure2012"), F.lit(0.123), F.lit("Tint"), F.lit(7.0))})
    thresholds = {"mid_low": 0.3, "mid_high": 0.5, "highlight_cap": 0.7, "shadow_floor": 0.1, "deep_shadow_cap": 0.05}
    same = tone.intended(df, "m", [], thresholds).collect()
    assert all(r["m"] == {"Exposure2012": 0.123, "Tint": 7.0} for r in same)
    half = {r["id"]: r["m"] for r in tone.intended(df, "m", ["expose-correctly"], thresholds, strength=0.5).collect()}
    whole = {r["id"]: r for r in tone.intended(df, "m", ["expose-correctly"], thresholds).collect()}
    assert any(r["m"]["Exposure2012"] != 0.123 for r in whole.values())
    for i, r in whole.items():
        t = (r["m"]["Exposure2012"], 0, 0, 0, 0, 0)
        assert set(r["m"]) == {"Exposure2012", "Tint"} and 0.29 < _plain_look(r["stops"], r["weights"], r["anchor"], t)[4] < 0.51
        assert abs(half[i]["Exposure2012"] - (r["m"]["Exposure2012"] + 0.123) / 2) < 0.011
    sky = tone.intended(df, "m", ["save-the-sky", "soft-contrast"], thresholds).collect()
    assert all(set(r["m"]) <= {"Exposure2012", "Tint", "Highlights2012", "Whites2012", "Contrast2012"} for r in sky) and all(r["left"] < 30 for r in sky)
    again = tone.Intent("dim", ("exposure",), 4, high="cap")
    dim = tone.intended(df, "m", ["dim"], {"cap": 0.2}, intents=(again,)).collect()
    assert all(r["left"] < 4 for r in dim)


def test_regions(spark):
    rnd = np.random.default_rng(4)
    luma, tiles = rnd.random((6, 8)), np.array([[1.0, 0.2], [0.5, 0.49]])
    df = spark.createDataFrame([(luma.ravel().tolist(), tiles.ravel().tolist())], "l array<double>, t array<double>")
    got = df.select(look.regional(F.col("l"), F.lit(8), F.lit(6), F.col("t"), F.lit(2), F.lit(2)).alias("m")).first()["m"]
    mask = np.kron(tiles >= 0.5, np.ones((3, 4), dtype=bool))
    for name, part in {"subject": luma[mask], "background": luma[~mask], "top": luma[:2].ravel(), "bottom": luma[4:].ravel()}.items():
        v = np.sort(part)
        rank = lambda p, v=v: v[min(len(v) - 1, int(p * len(v)))]
        assert np.allclose([got[name][k] for k in ("mean", "p05", "p95", "high", "low")], [v.mean(), rank(0.05), rank(0.95), (v >= 250 / 255).mean(), (v <= 5 / 255).mean()])


def test_looks_from_features(spark):
    """Looks that features explain, foretold in order for sessions that were not seen; the constant is what is left of
    noise."""
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = rnd.random(3)
        rows.append((i, i % 20, x.tolist(), np.sort(np.clip(np.linspace(0.05, 0.9, 9) * (0.5 + x[0] / 2) + rnd.normal(size=9) * 0.01, 0, 1)).tolist()))
    df = spark.createDataFrame(rows, "id int, session int, x array<double>, look array<double>")
    out = looks.foretold(df, "id", "session", "x", "look").collect()
    assert len(out) == 300 and all(np.all(np.diff(r["foretold"]) >= 0) for r in out)
    assert np.mean([r["off"] for r in out]) < 0.3 * np.mean([r["off_constant"] for r in out])
    swapped = spark.createDataFrame([([0.3, 0.2, 1.4, -0.1],)], "v array<double>").select(looks.ordered(F.col("v"))).first()[0]
    assert swapped == [0.3, 0.3, 1.0, 1.0]
    assert folds.dealt(df, "session", 5).groupBy("session").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("name", ["solve_tone", "meet_constraints", "apply_intents"])
def test_searches_are_dealt_over_all_tasks(spark, tmp_path, name):
    import __spark_entry__ as entry

    rows = [(i, [float(np.sin(i * 7 + j)) / 3 for j in range(64)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = entry.queries()[name](spark, str(tmp_path))
    held = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().withColumnRenamed("count", "n").collect()]
    assert sum(held) == 60 and len(held) >= 12 and max(held) <= 15


def test_trials_are_read_as_plain_percentiles():
    rnd = np.random.default_rng(11)
    stops, weights = tone._in_order(rnd.normal(-3, 3, 64), np.where(rnd.random(64) < 0.3, 0.0, rnd.random(64)))
    trials = rnd.uniform(-1, 1, (400, 6)) * tone.LIMIT
    logs = tone.shaped(stops, 0.5, trials)
    rising = tone._rising(logs)
    assert rising.any() and not rising.all()
    assert np.allclose(tone.Percentiles(weights)(logs, rising), tone.looks(tone.displayed(stops, 0.5, trials), weights), atol=1e-7)
