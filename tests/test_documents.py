"""Paths of documents against plain dictionaries, and the two editors' formats."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import documents
from tastegrid.operators import sidecars


def merge(base, patch, deletes=True):
    if not isinstance(patch, dict):
        return patch
    out = dict(base) if isinstance(base, dict) else {}
    for k, v in patch.items():
        if v is None and deletes:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v, deletes)
    return out


def made(rnd, depth=0, nulls=True):
    kind = rnd.random()
    if depth < 4 and kind < 0.55 or not depth:
        return {k: made(rnd, depth + 1, nulls) for k in rnd.sample(["a", "b", "c.d", "e'f", "ü"], rnd.randint(0, 4))}
    return rnd.choice([1, 2.5, "x", True, [1, {"a": 1}], [], "7", 0] + [None] * nulls)


def test_merge_and_difference_against_dictionaries(spark):
    rnd = random.Random(5)
    rows = [(i, json.dumps(made(rnd)), json.dumps(made(rnd)), json.dumps(made(rnd, nulls=False)), json.dumps(made(rnd, nulls=False))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string, d string")
    p = lambda c: documents.parsed(F.col(c))
    got = df.select("i", F.to_json(documents.merged(p("a"), p("b"))).alias("m"), F.to_json(documents.merged(p("a"), p("b"), deletes=False)).alias("k"), F.to_json(documents.difference(p("c"), p("d"))).alias("diff"), F.to_json(documents.merged(p("c"), documents.difference(p("c"), p("d")))).alias("again")).collect()
    for (i, a, b, c, d), r in zip(rows, sorted(got, key=lambda r: r["i"]), strict=True):
        a, b, c, d = map(json.loads, (a, b, c, d))
        assert json.loads(r["m"]) == merge(a, b) and json.loads(r["k"]) == merge(a, b, False)
        assert json.loads(r["again"]) == d and (r["diff"] is None) == (c == d)
        if r["diff"]:
            assert merge(c, json.loads(r["diff"])) == d


def test_reads_writes_and_leaves(spark):
    text = '{"a": {"b": 1.5, "c": "2", "x.y": 3, "n": null}, "l": [1], "e": {}, "inf": 1e999}'
    df = spark.createDataFrame([(text,), ("no json",), (None,), ("[1]",), ("5",)], "t string").select(documents.parsed(F.col("t")).alias("d"))
    d = F.col("d")
    rows = df.select(documents.number(d, "a.b"), documents.number(d, "a.c"), documents.text(d, "a.c"), documents.number(d, ("a", "x.y")), documents.number(d, "a.n"), documents.number(d, "a"), documents.number(d, "inf"), documents.number(d, "a.b.c")).collect()
    assert tuple(rows[0]) == (1.5, None, "2", 3.0, None, None, None, None) and all(v is None for r in rows[1:] for v in r)
    found = [None if r[0] is None else [(x["path"], json.loads(x["value"])) for x in r[0]] for r in df.filter("d IS NULL OR schema_of_variant(d) NOT LIKE '%inf%'").select(documents.leaves(d)).collect()]
    assert found == [None, None, [("", [1])], [("", 5)]]
    told = spark.range(1).select(documents.leaves(documents.parsed(F.lit('{"b": {"d": 1, "c": {}}, "a": [1]}'))).alias("l")).first()["l"]
    assert [(x["path"], x["value"]) for x in told] == [("a", "[1]"), ("b.c", "{}"), ("b.d", "1")]
    w = documents.written({"a.b": F.lit(1), "a.c": F.lit(None).cast("int"), "z.y.x": F.lit(None).cast("string"), ("k", "m.n"): F.lit("t")})
    assert spark.range(1).select(F.to_json(w)).first()[0] == '{"a":{"b":1},"k":{"m.n":"t"}}'
    assert spark.range(1).select(documents.written({"a": F.lit(None).cast("int")})).first()[0] is None
    for wrong in ({"a": F.lit(1), "a.b": F.lit(2)}, {"a.b": F.lit(1), "a": F.lit(2)}):
        with pytest.raises(ValueError, match="a"):
            documents.written(wrong)


def test_objects_that_are_too_deep_raise(spark):
    deep = lambda n: '{"a":' * n + "1" + "}" * n
    df = spark.createDataFrame([(deep(8), deep(8).replace("1", "2"))], "a string, b string").select(*[documents.parsed(F.col(c)).alias(c) for c in "ab"])
    for use in (documents.merged, documents.difference):
        with pytest.raises(Exception, match="more than 6 deep"):
            df.select(F.to_json(use(F.col("a"), F.col("b")))).collect()
    assert json.loads(df.select(F.to_json(documents.merged(F.col("a"), F.col("b"), levels=9))).first()[0]) == json.loads(deep(8).replace("1", "2"))
    with pytest.raises(Exception, match="more than 6 deep"):
        df.select(documents.leaves(F.col("a"))).collect()


def test_documents_of_one_editor_and_settings_of_the_other(spark):
    base = {"rating": 3, "exposure": 1, "hsl": {"reds": {"hue": 0, "saturation": 4}}, "masks": [{"id": 1}], "colorGrading": {"shadows": {"hue": 9}}}
    values = {"Exposure2012": 0.333, "Shadows2012": 90.0, "HueAdjustmentRed": 8.0, "SplitToningShadowHue": 20.0, "SplitToningHighlightHue": 30.0, "ColorGradeHighlightHue": 31.0, "Tint": -300.0, "Temperature": 4000.0, "Clarity2012": float("nan")}
    row = spark.createDataFrame([(json.dumps(base), values, [0.0, 5.0, 255.0, 250.0])], "d string, m map<string,double>, c array<double>")
    doc = row.select(F.to_json(sidecars.applied(documents.parsed(F.col("d")), F.col("m"), F.col("c"), F.lit(5000.0))).alias("t"), "m")
    got = json.loads(doc.first()["t"])
    assert got["exposure"] == 0.33 and got["shadows"] == 100 and got["hsl"] == {"reds": {"hue": 6, "saturation": 4}} and got["tint"] == -100
    assert got["colorGrading"] == {"shadows": {"hue": 20}, "highlights": {"hue": 31}} and got["masks"] == base["masks"] and got["rating"] == 3 and "clarity" not in got
    assert abs(got["temperature"] - round(-(1e6 / 4000 - 1e6 / 5000) / 150 * 100, 2)) < 0.011 and got["curves"]["luma"] == [{"x": 0, "y": 5}, {"x": 255, "y": 250}] and got["curveMode"] == "point"
    d = documents.parsed(F.col("t"))
    back = doc.select(sidecars.settings(d).alias("m"), sidecars.temperature(d, F.lit(5000.0)).alias("k"), sidecars.curve(d).alias("c"), sidecars.edited(d).alias("e")).first()
    assert abs(back["m"]["HueAdjustmentRed"] - 8) < 1e-9 and abs(back["m"]["Shadows2012"] - 100 / 1.5) < 1e-9 and abs(back["k"] - 4000) < 1 and back["c"] == [0, 5, 255, 250] and back["e"]
    nothing = row.select(F.to_json(sidecars.applied(documents.parsed(F.lit("{}")), F.create_map().cast("map<string,double>"), F.lit(None).cast("array<double>"), F.lit(None).cast("double"))).alias("t")).first()["t"]
    assert list(json.loads(nothing)) == ["sectionVisibility"] and row.select(sidecars.temperature(documents.parsed(F.lit("{}")), F.lit(5000.0))).first()[0] is None
    assert len(sidecars.GEARS) == 67 and len({g.path for g in sidecars.GEARS}) == 67


def test_neutral_documents(spark):
    rest = {"exposure": 0, "grainSize": 25, "vignetteMidpoint": 50, "colorGrading": {"blending": 50}, "sharpness": 40, "lensDistortionEnabled": True, "curves": {"luma": [{"x": 0, "y": 0.4}, {"x": 255, "y": 255}], "red": [{"x": 0, "y": 90}]}, "lutPath": ""}
    cases = [(rest, False), (merge(rest, {"grainSize": 26}), True), (merge(rest, {"hsl": {"blues": {"hue": 1e-7}}}), False), (merge(rest, {"curves": {"blue": [{"x": 0, "y": 0}, {"x": 9, "y": 20}]}}), True), (merge(rest, {"lutPath": "x.cube"}), True), (merge(rest, {"exposure": "2"}), False), (merge(rest, {"brightness": 1}), True), ([], False)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", sidecars.edited(documents.parsed(F.col("t"))).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases] and got[99] is False


def test_tags_of_a_record(spark):
    cases = {'{"Exposure2012": "+0.50", "ColorTemperature": 5200, "ConvertToGrayscale": true, "Clarity2012": "n/a", "Own": 1}': {"Exposure2012": 0.5, "Temperature": 5200.0, "ConvertToGrayscale": 1.0}, '{"Temperature": 4000, "ColorTemperature": 5200}': {"Temperature": 4000.0}, "{}": {}, "bad": {}, '{"Dehaze": "NaN"}': {}}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string").select("i", sidecars.ingested(F.col("t")).alias("m"))
    assert [r["m"] for r in df.orderBy("i").collect()] == list(cases.values())
