"""Queries of edit documents and sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents
from ..operators import sidecars
from ..registry import query
from .base import r6, spread, table

_DELETES = "CASE WHEN event_id % 3 = 0 THEN json_object('k', NULL) ELSE json_object() END"


@query("dotted_merge", f"""WITH a AS (SELECT event_id, user_id, json_merge_patch(json_merge_patch(props::JSON, json_object('edit', json_object('tone', json_object('exposure', event_id % 40 / 8.0, 'contrast', event_id % 7), 'by', user_id), 'tags', json_array(event_type, event_id % 2))), {_DELETES}) AS d FROM events),
  b AS (SELECT event_id, json_merge_patch(d, CASE WHEN user_id % 2 = 0 THEN json_object('edit', json_object('tone', json_object('contrast', -1, 'curve', json_array(0, 255)), 'by', NULL)) ELSE json_object('edit', json_object('tone', json_object('contrast', -1, 'curve', json_array(0, 255)))) END) AS d FROM a)
  SELECT event_id, (d->>'$.k')::DOUBLE AS k, (d->>'$.edit.tone.exposure')::DOUBLE AS exposure, (d->>'$.edit.tone.contrast')::DOUBLE AS contrast, (d->>'$.edit.by')::DOUBLE AS by, json_array_length(d->'$.tags')::INT AS n_tags, (d->>'$.edit.tone.curve[1]')::DOUBLE AS curve_end,
    ((SELECT count(*) FROM json_each(d->'$.edit.tone')) + (SELECT count(*) FROM json_each(d->'$.edit')) - 1 + (SELECT count(*) FROM json_each(d)) - 1)::INT AS n_leaves, true AS undone FROM b""")
def dotted_merge(spark, sf_dir):
    """Properties with two patches over them, the second of which deletes; the difference of both states applied again
    gives the later one."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"))
    tone = {"edit.tone.exposure": F.col("event_id") % 40 / 8.0, "edit.tone.contrast": F.col("event_id") % 7, "edit.by": F.col("user_id"), "tags": F.array(F.col("event_type").cast("variant"), (F.col("event_id") % 2).cast("variant")), "k": F.when(F.col("event_id") % 3 == 0, documents.nothing())}
    later = {"edit.tone.contrast": F.lit(-1), "edit.tone.curve": F.array(F.lit(0), F.lit(255)), "edit.by": F.when(F.col("user_id") % 2 == 0, documents.nothing())}
    once = e.select("event_id", documents.parsed(F.col("props")).alias("p"), documents.merged(documents.parsed(F.col("props")), documents.written(tone)).alias("a"), documents.written(later).alias("l"))
    d = once.select("event_id", "p", documents.merged(F.col("a"), F.col("l")).alias("d"))
    again = documents.merged(F.col("p"), documents.difference(F.col("p"), F.col("d")))
    of = lambda path: documents.number(F.col("d"), path)
    return d.select("event_id", of("k").alias("k"), of("edit.tone.exposure").alias("exposure"), of("edit.tone.contrast").alias("contrast"), of("edit.by").alias("by"), F.size(documents.part(F.col("d"), "tags").try_cast("array<variant>")).alias("n_tags"), F.try_variant_get("d", "$.edit.tone.curve[1]", "double").alias("curve_end"), F.size(documents.leaves(F.col("d"))).alias("n_leaves"), (F.to_json(again) == F.to_json("d")).alias("undone"))


_G = ", ".join(f"({i}, '{g.setting}', '{g.path}', {g.factor!r}::DOUBLE, {'NULL' if g.low is None else float(g.low)}::DOUBLE, {'NULL' if g.high is None else float(g.high)}::DOUBLE)" for i, g in enumerate(sidecars.GEARS))
#: A document of someone's before any setting is written.
BASE = '{"exposure": 0.5, "masks": [1, 2], "crop": null, "hsl": {"reds": {"hue": 3, "own": "kept"}}, "tint": 200}'
_VALUE = "(p_partkey * (i + 3) % 401 - 200) / 2.0::DOUBLE"


def _settings():
    """A map of settings that leaves out three in four, others for other parts."""
    value = lambda i: (F.col("p_partkey") * (i + 3) % 401 - 200) / 2.0
    entries = F.array(*[F.struct(F.lit(g.setting).alias("key"), F.when((F.col("p_partkey") + i) % 4 == 0, value(i)).alias("value")) for i, g in enumerate(sidecars.GEARS)])
    return F.map_concat(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())), F.create_map(F.lit("Temperature"), F.col("p_retailprice") * 4))


@query("rr_roundtrip", f"""WITH g(i, setting, path, factor, low, high) AS (VALUES {_G}),
  w AS (SELECT p_partkey, setting, path, factor, floor(least(greatest({_VALUE} * factor, coalesce(low, -1e9)), coalesce(high, 1e9)) * 100 + 0.5) / 100 / factor AS back FROM part, g WHERE (p_partkey + i) % 4 = 0),
  old AS (SELECT p_partkey, setting, factor, CASE path WHEN 'exposure' THEN 0.5 WHEN 'hsl.reds.hue' THEN 3 WHEN 'tint' THEN 200 END / factor AS back FROM part, g WHERE path IN ('exposure', 'hsl.reds.hue', 'tint') AND (p_partkey + i) % 4 <> 0)
  SELECT p_partkey, setting, floor(back * 1e6 + 0.501) / 1e6 AS back, true AS kept, floor(1e6 / least(greatest(1e6 / 5000 - floor(least(greatest((1e6 / greatest(p_retailprice * 4, 1) - 1e6 / 5000) * (-100 / 150.0::DOUBLE), -100), 100) * 100 + 0.5) / 100 * 1.5, 20), 500) * 1e3 + 0.501) / 1e3 AS kelvin
  FROM (SELECT p_partkey, setting, back FROM w UNION ALL SELECT p_partkey, setting, back FROM old) JOIN part USING (p_partkey)""")
def rr_roundtrip(spark, sf_dir):
    """Settings merged into someone's document and read back, every gear: what was not written is as it was."""
    held = spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")).withColumn("m", _settings())
    doc = sidecars.applied(documents.parsed(F.lit(BASE)), F.col("m"), F.lit(None).cast("array<double>"), F.lit(5000.0))
    kept = lambda d: (documents.text(d, "hsl.reds.own") == "kept") & (F.to_json(documents.part(d, "masks")) == "[1,2]")
    # a document is made once and read from there
    told = F.transform(F.array(doc), lambda d: F.struct(sidecars.settings(d).alias("back"), kept(d).alias("kept"), sidecars.temperature(d, F.lit(5000.0)).alias("kelvin")))
    read = held.select("p_partkey", F.explode(told).alias("t")).select("p_partkey", F.explode("t.back").alias("setting", "back"), "t.kept", "t.kelvin")
    return read.select("p_partkey", "setting", r6(F.col("back")).alias("back"), "kept", (F.floor(F.col("kelvin") * 1e3 + 0.501) / 1e3).alias("kelvin"))


@query("rr_edited", """SELECT p_partkey, p_size > 25 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS edited, CASE WHEN p_partkey % 7 = 0 THEN 6 END::INT AS n_curve FROM part""")
def rr_edited(spark, sf_dir):
    """Whether a document holds an edit: sliders off their rest, curves, colour tables; defaults and noise do not count."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    middle = F.when(F.col("p_partkey") % 7 == 0, 90.0).otherwise(F.lit(128.4))
    points = F.array(*[F.struct(F.lit(x).alias("x"), y.alias("y")) for x, y in ((0.0, F.lit(0.0)), (128.0, middle), (255.0, F.lit(255.0)))])
    values = {"grainSize": F.lit(25), "vignetteMidpoint": F.lit(50.0000004), "sharpness": F.lit(40), "clarity": F.when(F.col("p_size") > 25, F.col("p_size")), "exposure": F.lit("1.5"), "curves.luma": F.to_variant_object(points), "lutPath": F.when(F.col("p_partkey") % 5 == 0, "a.cube").otherwise("")}
    d = p.select("p_partkey", documents.written(values).alias("d"))
    return d.select("p_partkey", sidecars.edited(F.col("d")).alias("edited"), F.nullif(F.size(F.coalesce(sidecars.curve(F.col("d")), F.array().cast("array<double>"))), F.lit(0)).alias("n_curve"))


@query("ingest_tags", """SELECT event_id, (json_extract(props, '$.k'))::DOUBLE AS "Exposure2012", CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "ConvertToGrayscale", 5500.0::DOUBLE AS "Temperature", 3::INT + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END::INT AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL
  UNION ALL SELECT event_id, NULL, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END, 5500.0, 2 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END FROM events WHERE json_extract(props, '$.k') IS NULL""")
def ingest_tags(spark, sf_dir):
    """Records of a metadata reader as numbers by tag: booleans, texts that are numbers, a tag under the reader's name,
    and what is no number or not wanted."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "props"))
    record = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("Exposure2012"), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False").alias("ConvertToGrayscale"), F.lit(5500).alias("ColorTemperature"), F.lit("As Shot").alias("WhiteBalance"), F.lit("none").alias("Clarity2012"), F.when(F.col("event_id") % 4 == 0, " -7 ").alias("Dehaze")))
    m = e.select("event_id", sidecars.ingested(record).alias("m"))
    return m.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("Exposure2012", "ConvertToGrayscale", "Temperature")], F.size("m").alias("n"))


@query("emit_settings", f"""WITH p AS (SELECT p_partkey, p_name, p_size, floor((p_size - 25) / 10.0 * 100 + 0.5) / 100 AS e FROM part)
  SELECT p_partkey, '{sidecars.HEAD}crs:ConvertToGrayscale="' || CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END || '" ' || CASE WHEN p_partkey % 3 = 0 THEN 'crs:CameraProfile="' || replace(replace(replace(replace(p_name || ' <A&B>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '" ' ELSE '' END
    || 'crs:Exposure2012="' || printf('%+.2f', e) || '" crs:Contrast2012="' || floor(p_size / 3.0 + 0.5)::BIGINT || '">' || CASE WHEN p_size > 20 THEN '<crs:ToneCurvePV2012><rdf:Seq><rdf:li>0, 0</rdf:li><rdf:li>128, ' || p_size || '.5</rdf:li></rdf:Seq></crs:ToneCurvePV2012>' || {" || ".join(f"'<crs:ToneCurvePV2012{c}><rdf:Seq><rdf:li>0, 0</rdf:li><rdf:li>255, 255</rdf:li></rdf:Seq></crs:ToneCurvePV2012{c}>'" for c in ("Red", "Green", "Blue"))} ELSE '' END
    || CASE WHEN p_partkey % 5 = 0 THEN '<crs:Look><x/></crs:Look>' ELSE '' END || '{sidecars.TAIL}' AS line FROM p""")
def emit_settings(spark, sf_dir):
    """Sidecars as text: settings, treatment, profile, curve and look."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    values = F.create_map(F.lit("Contrast2012"), F.col("p_size") / 3.0, F.lit("Exposure2012"), (F.col("p_size") - 25) / 10.0, F.lit("Dehaze"), F.lit(float("nan")), F.lit("Unknown"), F.lit(1.0))
    curve = F.when(F.col("p_size") > 20, F.array(F.lit(0.0), F.lit(0.0), F.lit(128.0), F.col("p_size") + 0.5))
    profile = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" <A&B>")))
    look = F.when(F.col("p_partkey") % 5 == 0, "<crs:Look><x/></crs:Look>")
    return p.select("p_partkey", sidecars.emitted(values, curve, F.col("p_partkey") % 2 == 0, profile, look).alias("line"))
