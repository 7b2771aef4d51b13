"""Calibration from known frames and transfer between treatments against plain versions; catalogue exports."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import folds, probes, sidecars
from tastegrid.sources import catalogs


def test_calibration_curve_as_done_plainly(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for s in range(25):
        off = rnd.normal(size=2)
        for i in range(int(rnd.integers(1, 9))):
            p = rnd.normal(size=2)
            rows.append((f"{s}/{i}", s, p.tolist(), (p + off + 0.3 * rnd.normal(size=2)).tolist(), [0.1, -0.1]))
    df = spark.createDataFrame(rows, "file string, session int, p array<double>, y array<double>, c array<double>").repartition(5)
    got = {(r["k"], r["target"], r["method"]): (r["n"], r["mae"]) for r in probes.calibration_curve(df, "file", "session", "p", "y", "c", (0, 1, 3)).collect()}
    by = {}
    for f, s, p, y, c in rows:
        by.setdefault(s, []).append((hashlib.md5(f.encode()).hexdigest(), np.array(p), np.array(y), np.array(c)))
    res = [np.array([y - p for _, p, y, _ in v]) for v in by.values() if len(v) > 1]
    within = sum(((r - r.mean(axis=0)) ** 2).sum(axis=0) for r in res) / sum(len(r) for r in res)
    grand = np.concatenate(res).mean(axis=0)
    between = np.maximum(1e-9, np.mean([(r.mean(axis=0) - grand) ** 2 for r in res], axis=0) - within / np.mean([len(r) for r in res]))
    kappa, off = within / between, {}
    for v in by.values():
        v.sort(key=lambda x: x[0])
        for k in (0, 1, 3):
            if len(v) >= k + 2:
                shift = np.mean([y - p for _, p, y, _ in v[:k]], axis=0) if k else None
                for _, p, y, c in v[k:]:
                    said = {"constant": c, "model": p} | ({"shoot mean": np.mean([y for _, _, y, _ in v[:k]], axis=0), "model + offset": p + shift, "model + shrunk offset": p + k / (k + kappa) * shift} if k else {})
                    for m, x in said.items():
                        for t in range(2):
                            off.setdefault((k, t, m), []).append(abs(x[t] - y[t]))
    assert got.keys() == off.keys() and all(got[key][0] == len(v) and abs(got[key][1] - np.mean(v)) < 1e-9 for key, v in off.items())
    assert got[3, 0, "model + shrunk offset"][1] < got[3, 0, "model"][1]


def test_deviations_of_a_hot_group_are_many_tasks(spark, monkeypatch):
    """Vectors less their group's mean by place, null groups too; a group that most rows have is not one task, and a
    group without numbers has no rows."""
    rnd = np.random.default_rng(8)
    rows = [(i, None if i % 50 == 1 else i % 5 if i % 10 == 0 else 9, rnd.normal(size=2 + (i % 5 == 0)).tolist(), rnd.normal(size=1).tolist()) for i in range(2000)]
    rows += [(2000 + i, 77, [], [1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, g int, x array<double>, y array<double>")
    by = {}
    for _, g, x, y in rows:
        for c, v in (("x", x), ("y", y)):
            for j, a in enumerate(v):
                by.setdefault((g, c, j), []).append(a)
    wide = {g: sum((g, "x", j) in by for j in range(3)) for _, g, _, _ in rows}
    for conf, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(conf, value)
    try:
        for most in (probes.BROADCAST_NUMBERS, 0):
            monkeypatch.setattr(probes, "BROADCAST_NUMBERS", most)
            out = probes.deviations(df.repartition(4), ["g"], ["x", "y"]).withColumn("task", F.spark_partition_id()).collect()
            got = {r["i"]: (r["x"], r["y"]) for r in out}
            assert len(out) == len(got) == 2000 and max(sum(r["task"] == t for r in out) for t in range(4)) < 1200
            for i, g, x, y in rows[:2000]:
                want = [x[j] - np.mean(by[g, "x", j]) if j < len(x) else None for j in range(wide[g])], [y[0] - np.mean(by[g, "y", 0])]
                assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for u, v in zip(got[i], want, strict=True) for a, b in zip(u, v, strict=True))
    finally:
        for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(conf)


def _treated(spark, other, n=400):
    rnd = np.random.default_rng(6)
    rows = []
    for i in range(n):
        x, bw = rnd.normal(size=2), i % 4 == 0
        slope = other if bw else 2.0
        rows.append(("bw" if bw else "color", i % 20, (x + i % 20).tolist(), [float(slope * x[0] + 5 * (i % 20) + 0.1 * rnd.normal())]))
    return spark.createDataFrame([*rows, (None, 1, [0.0, 0.0], [0.0])], "t string, s int, x array<double>, y array<double>")


def test_transfer_between_treatments(spark):
    """Treatments that go alike help each other; ones that go against each other are best alone."""
    alike = {(a, b): skill for a, b, _, _, skill in probes.treatment_transfer(_treated(spark, 2.0), "t", "s", "x", "y")}
    assert set(alike) == {(a, b) for a in ("bw", "color", "pooled") for b in ("bw", "color")} and all(v > 0.8 for v in alike.values())
    against = {(a, b): skill for a, b, _, _, skill in probes.treatment_transfer(_treated(spark, -2.0), "t", "s", "x", "y")}
    assert against["bw", "bw"] > 0.8 and against["color", "color"] > 0.8 and against["color", "bw"] < 0 and against["pooled", "bw"] < 0.3


def test_transfer_as_done_plainly(spark):
    df = _treated(spark, 1.0, 200)
    got = {(a, b): mae for a, b, _, mae, _ in probes.treatment_transfer(df, "t", "s", "x", "y", k=3, penalties=(0.1, 10.0))}
    rows = [(r["t"], r["fold"], np.array(r["x"]), np.array(r["y"]), r["s"]) for r in folds.dealt(df.filter("t IS NOT NULL"), "s", 3).collect()]
    mean = lambda t, s, i: np.mean([r[i] for r in rows if r[0] == t and r[4] == s], axis=0)
    rows = [(t, f, x - mean(t, s, 2), (y - mean(t, s, 3))[0]) for t, f, x, y, s in rows]

    def fit(train, penalty):
        x, y = np.array([r[2] for r in train]), np.array([r[3] for r in train])
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        b = np.linalg.solve(z.T @ z + penalty * len(x) * np.eye(2), z.T @ (y - y.mean())) / x.std(axis=0)
        return lambda v: v @ b + y.mean() - x.mean(axis=0) @ b

    off = lambda model, test: sum(abs(model(r[2]) - r[3]) for r in test)
    for name, names in {"bw": ["bw"], "color": ["color"], "pooled": ["bw", "color"]}.items():
        own = [r for r in rows if r[0] in names]
        for tried in ("bw", "color"):
            total = n = 0
            for f in range(3):
                inner = [sum(off(fit([r for r in own if r[1] not in (f, g)], p), [r for r in own if r[1] == g]) for g in range(3) if g != f) for p in (0.1, 10.0)]
                test = [r for r in rows if r[0] == tried and r[1] == f]
                total, n = total + off(fit([r for r in own if r[1] != f], (0.1, 10.0)[int(np.argmin(inner))]), test), n + len(test)
            assert abs(got[name, tried] - total / n) < 1e-8


def _export(path, body):
    path.write_text(body if isinstance(body, str) else json.dumps(body))
    return f"file://{path}"


def test_catalogue_exports(spark, tmp_path):
    good = {"version": 1, "folder": "/A", "roots": ["/A", 3], "photos": [{"path": "/A/x.RAW", "settings": {"Exposure2012": 0.5, "ConvertToGrayscale": True, "ToneCurvePV2012": [0, 0, 255, 250], "Look": {"Name": "n"}, "Temperature": 5200}}, {"path": 3, "settings": {}}, {"path": "/A/y"}, None, {"path": "/A\\sub//./z.raw", "settings": {}}]}
    one, two = _export(tmp_path / "1.json", good), _export(tmp_path / "2.json", {"version": 1, "photos": [], "found": False})
    rows = {r["folder"]: r for r in catalogs.exports(spark, one, two).collect()}
    assert rows["/A"]["found"] and rows["/A"]["roots"] == ["/A"] and not rows[""]["found"] and rows[""]["roots"] == []
    found = catalogs.photos(spark, one, two)
    assert sorted(r["path"] for r in found.filter("bad IS NULL").collect()) == ["/A/x.RAW", "/A\\sub//./z.raw"] and found.filter("bad IS NOT NULL").count() == 3
    files = spark.createDataFrame([("/a/X.raw",), ("/A/sub/z.RAW/",), ("/A/none",)], "path string")
    m = {r["path"]: (r["s"], r["m"]) for r in catalogs.matched(files, found).select("path", F.col("settings").isNotNull().alias("s"), sidecars.ingested(catalogs.record(F.col("settings"))).alias("m")).collect()}
    assert m["/a/X.raw"] == (True, {"Exposure2012": 0.5, "ConvertToGrayscale": 1.0, "Temperature": 5200.0}) and m["/A/sub/z.RAW/"][0] and not m["/A/none"][0]
    assert catalogs.matched(files, found, case=True).filter("settings IS NOT NULL").count() == 0
    for body, said in (("{", "not valid JSON"), ({"version": 1}, "no photos"), ({"version": 2, "photos": []}, "version 2; this reads version 1"), ({"photos": []}, "version none")):
        with pytest.raises(Exception, match=said):
            catalogs.photos(spark, _export(tmp_path / "bad.json", body)).collect()
            catalogs.exports(spark, _export(tmp_path / "bad.json", body)).collect()
