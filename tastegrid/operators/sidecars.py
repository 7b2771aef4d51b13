"""Edit documents of one editor and the settings of another: names, gears, white balance, curves, neutral states.

The canonical settings are a map of names to numbers; an editor's document keeps the same sliders at dotted paths, some
of them geared. Documents are patched, never replaced: what the settings do not say stays as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import documents
from ..functions.jsmath import clamp


def _within(value: Column, low: float, high: float) -> Column:
    """value between its limits; a null stays null."""
    return F.when(value.isNotNull(), clamp(value, low, high))


@dataclass(frozen=True)
class Gear:
    """A setting, its path in a document, how much of the document's unit one of its own is, and the document's limits."""

    setting: str
    path: str
    factor: float = 1.0
    low: float | None = None
    high: float | None = None

    def out(self, value: Column) -> Column:
        geared = value * self.factor if self.factor != 1 else value
        return _within(geared, self.low, self.high) if self.low is not None else geared


#: Names of the two formats for the same sliders (fixed values).
SAME = """
Exposure2012 exposure, Contrast2012 contrast, Highlights2012 highlights, Whites2012 whites, Blacks2012 blacks, Clarity2012 clarity,
Dehaze dehaze, Texture structure, Vibrance vibrance, Saturation saturation, PostCropVignetteAmount vignetteAmount,
PostCropVignetteMidpoint vignetteMidpoint, PostCropVignetteFeather vignetteFeather, PostCropVignetteRoundness vignetteRoundness,
GrainAmount grainAmount, GrainSize grainSize, GrainFrequency grainRoughness, ShadowTint colorCalibration.shadowsTint,
ColorGradeBlending colorGrading.blending, SplitToningBalance colorGrading.balance, LuminanceSmoothing lumaNoiseReduction,
ColorNoiseReduction colorNoiseReduction
"""
#: Channels, regions and aspects by their names in the two formats, gears and limits (fixed values).
CHANNELS = "Red reds, Orange oranges, Yellow yellows, Green greens, Aqua aquas, Blue blues, Purple purples, Magenta magentas"
REGIONS = "Shadow shadows, Midtone midtones, Highlight highlights, Global global"
ASPECTS = "Hue hue, Sat saturation, Lum luminance"
SHADOW_GEAR, DETAIL_GEAR, HUE_GEAR, TINT_GEAR = 1.5, 1 / 1.5, 0.75, 1 / 1.5


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in text.replace("\n", " ").split(",")]


def _gears() -> tuple[Gear, ...]:
    out = [Gear(a, b) for a, b in _pairs(SAME)]
    out += [Gear("Shadows2012", "shadows", SHADOW_GEAR, -100, 100), Gear("Sharpness", "sharpness", DETAIL_GEAR, 0, 100), Gear("Tint", "tint", TINT_GEAR, -100, 100)]
    for colour in ("Red", "Green", "Blue"):
        out += [Gear(f"{colour}{what}", f"colorCalibration.{colour.lower()}{what}") for what in ("Hue", "Saturation")]
    for name, key in _pairs(CHANNELS):
        out += [Gear(f"HueAdjustment{name}", f"hsl.{key}.hue", HUE_GEAR), Gear(f"SaturationAdjustment{name}", f"hsl.{key}.saturation"), Gear(f"LuminanceAdjustment{name}", f"hsl.{key}.luminance")]
    for region, key in _pairs(REGIONS):
        out += [Gear(f"ColorGrade{region}{aspect}", f"colorGrading.{key}.{to}") for aspect, to in _pairs(ASPECTS)]
    return tuple(out)


GEARS = _gears()
#: An older setting that stands in where the newer one is absent: (older, newer) (fixed values).
STAND_INS = (
    ("SplitToningShadowHue", "ColorGradeShadowHue"), ("SplitToningShadowSaturation", "ColorGradeShadowSat"),
    ("SplitToningHighlightHue", "ColorGradeHighlightHue"), ("SplitToningHighlightSaturation", "ColorGradeHighlightSat"),
)
#: White balance: mired over half the slider, the capture's temperature where it is not known, limits in mired, slider's
#: half width (fixed values).
MIRED_SPAN, AS_SHOT, MIRED_LIMITS, SLIDER = 150.0, 5500.0, (20.0, 500.0), 100.0
#: Sliders that no setting moves but that make an edit, and the sliders that do not rest at 0 (fixed values).
OWN_SLIDERS = ("brightness", "temperature", "hue", "glowAmount", "halationAmount", "flareAmount")
RESTS = {"vignetteMidpoint": 50.0, "vignetteFeather": 50.0, "grainSize": 25.0, "grainRoughness": 50.0, "colorGrading.blending": 50.0}
#: Sliders that say nothing about the look: detail, which every file has.
DETAIL = ("sharpness", "lumaNoiseReduction", "colorNoiseReduction")
TOLERANCE, CURVE_TOLERANCE = 1e-6, 0.5
#: Settings of a sidecar that no document of the other editor has, and the one tag that a metadata reader names otherwise
#: (fixed values).
MONOCHROME = "ConvertToGrayscale"
TAGS = (*(g.setting for g in GEARS), *(old for old, _ in STAND_INS), "Temperature", MONOCHROME, *(f"GrayMixer{name}" for name, _ in _pairs(CHANNELS)))
ALIASES = {"ColorTemperature": "Temperature"}
#: What a sidecar begins and ends with (fixed values of the format).
HEAD = '<?xml version="1.0" encoding="UTF-8"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" crs:Version="15.0" crs:ProcessVersion="11.0" crs:WhiteBalance="Custom" '
TAIL = "</rdf:Description></rdf:RDF></x:xmpmeta>"
CURVES = ("luma", "red", "green", "blue")
#: Parts of the editor's panel that have to be shown for what is written in them to count (fixed values).
SECTIONS = ("basic", "color", "curves", "details", "effects")


def _mired(kelvin: Column) -> Column:
    return 1e6 / kelvin


def _capture(as_shot: Column) -> Column:
    return F.when(as_shot > 0, as_shot).otherwise(AS_SHOT)


def relative_temperature(kelvin: Column, as_shot: Column) -> Column:
    """The slider's place for a temperature, seen from that of the capture."""
    away = _mired(_within(kelvin, 1.0, float("inf"))) - _mired(_capture(as_shot))
    return _within(away * (-SLIDER / MIRED_SPAN), -SLIDER, SLIDER)


def temperature(doc: Column, as_shot: Column) -> Column:
    """The temperature that a document amounts to once the capture's is known; null where it says nothing of it."""
    return _mired(_within(_mired(_capture(as_shot)) - documents.number(doc, "temperature") * (MIRED_SPAN / SLIDER), *MIRED_LIMITS))


def _two_places(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def patch(settings: Column, curve: Column, as_shot: Column) -> Column:
    """What a document has to be merged with to show the settings (a map) and the curve (x0, y0, x1, y1, ..., null: as it
    is). Settings that are absent or no finite numbers are not written."""
    older = {new: old for old, new in STAND_INS}
    have = lambda name: _finite(F.try_element_at(settings, F.lit(name)))
    values: dict[str, Column] = {}
    for g in GEARS:
        value = F.coalesce(have(g.setting), have(older[g.setting])) if g.setting in older else have(g.setting)
        values[g.path] = _two_places(g.out(value))
    values["temperature"] = _two_places(relative_temperature(have("Temperature"), as_shot))
    points = F.when(F.size(curve) >= 4, F.transform(F.sequence(F.lit(0), F.floor(F.size(curve) / 2).cast("int") - 1), lambda i: F.struct(F.get(curve, 2 * i).alias("x"), F.get(curve, 2 * i + 1).alias("y"))))
    drawn = F.when(points.isNotNull(), F.to_variant_object(points))
    values |= {"curves.luma": drawn, "pointCurves.luma": drawn, "curveMode": F.when(points.isNotNull(), "point")}
    values |= {f"sectionVisibility.{s}": F.lit(True) for s in SECTIONS}
    return documents.written(values)


def applied(doc: Column, settings: Column, curve: Column, as_shot: Column) -> Column:
    """The document with the settings; all else in it stays."""
    return documents.merged(doc, patch(settings, curve, as_shot), deletes=False)


def settings(doc: Column) -> Column:
    """The settings that a document shows, as a map. Temperatures are left out, as the document knows them only relative
    to the capture (see `temperature`)."""
    entries = F.array(*[F.struct(F.lit(g.setting).alias("key"), (documents.number(doc, g.path) / g.factor).alias("value")) for g in GEARS])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _points(doc: Column, channel: str) -> Column:
    """The points of a channel's curve; null where they are fewer than two or not all numbers."""
    found = documents.part(doc, f"curves.{channel}").try_cast("array<variant>")
    points = F.transform(found, lambda p: F.struct(documents.number(p, "x").alias("x"), documents.number(p, "y").alias("y")))
    return F.when((F.size(points) >= 2) & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), points)


def _drawn(points: Column) -> Column:
    return F.coalesce(F.exists(points, lambda p: F.abs(p["x"] - p["y"]) > CURVE_TOLERANCE), F.lit(False))


def curve(doc: Column) -> Column:
    """The luma curve as x0, y0, x1, y1, ...; null where it is the identity or none."""
    points = _points(doc, "luma")
    return F.when(_drawn(points), F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"]))))


def neutral() -> dict[str, float]:
    """Where the sliders that make a look rest, by path."""
    paths = [g.path for g in GEARS if g.path not in DETAIL] + list(OWN_SLIDERS)
    return {p: RESTS.get(p, 0.0) for p in paths}


def edited(doc: Column) -> Column:
    """Whether a document holds a look and not only what its editor writes by itself: a slider off its rest, a curve, or a
    colour table."""
    sliders = F.array(*[F.abs(documents.number(doc, p) - rest) > TOLERANCE for p, rest in neutral().items()])
    moved = F.exists(sliders, lambda off: F.coalesce(off, F.lit(False)))
    table = F.coalesce(documents.text(doc, "lutPath") != "", F.lit(False))
    channels = F.lit(False)
    for c in CURVES:
        channels = channels | _drawn(_points(doc, c))
    return F.coalesce(moved | channels | table, F.lit(False))


def ingested(record: Column, tags: tuple[str, ...] = TAGS, aliases: dict[str, str] = ALIASES) -> Column:
    """A record of tags (JSON, as a metadata reader tells them) as numbers by tag: True and False are 1 and 0, texts that
    are numbers are numbers, anything else is left out, as are tags that are not wanted. aliases: the names of a
    reader, and what they stand for."""
    names = {t: t for t in tags} | {other: t for other, t in aliases.items() if t in tags}
    wanted = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    value = lambda v: F.when(F.lower(v) == "true", 1.0).when(F.lower(v) == "false", 0.0).otherwise(_finite(F.trim(v).try_cast("double")))
    told = F.transform(F.map_entries(F.from_json(record, "map<string,string>")), lambda e: F.struct(F.try_element_at(wanted, e["key"]).alias("key"), value(e["value"]).alias("value")))
    held = F.filter(told, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    # of a tag under two names its own stands
    return F.coalesce(F.map_from_entries(F.transform(F.array_distinct(F.transform(held, lambda e: e["key"])), lambda k: F.struct(k, F.filter(held, lambda e: e["key"] == k)[0]["value"]))), F.create_map().cast("map<string,double>"))


def escaped(value: Column) -> Column:
    """Text for an XML attribute."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


def formatted(name: str, value: Column) -> Column:
    """A setting as a sidecar writes it: exposure signed with two places, all else a whole number."""
    if name == "Exposure2012":
        return F.format_string("%+.2f", _two_places(value))
    return F.floor(value + 0.5).cast("long").cast("string")


def _sequence(tag: str, points: Column) -> Column:
    """A curve's element; points: texts "x, y"."""
    return F.concat(F.lit(f"<crs:{tag}><rdf:Seq>"), F.array_join(F.transform(points, lambda p: F.concat(F.lit("<rdf:li>"), p, F.lit("</rdf:li>"))), ""), F.lit(f"</rdf:Seq></crs:{tag}>"))


def emitted(settings: Column, curve: Column, monochrome: Column, profile: Column, look: Column, names: tuple[str, ...] | None = None) -> Column:
    """A sidecar as text: an attribute for each setting that is there, in the order of names; whether it is monochrome,
    which is always said; the base profile; the curve (x0, y0, ...) with its three straight companions; and the look's
    own element as it was read, unchanged. Null parts are left out."""
    have = lambda n: _finite(F.try_element_at(settings, F.lit(n)))
    attribute = lambda n, v: F.concat(F.lit(f'crs:{n}="'), v, F.lit('"'))
    said = [attribute(n, formatted(n, have(n))) for n in names or TAGS if n != MONOCHROME]
    attributes = F.array_compact(F.array(attribute(MONOCHROME, F.when(monochrome, "True").otherwise("False")), attribute("CameraProfile", escaped(profile)), *said))
    plain = lambda v: F.when(v == F.floor(v), F.floor(v).cast("long").cast("string")).otherwise(v.cast("string"))
    at = F.sequence(F.lit(0), F.greatest(F.floor(F.size(curve) / 2).cast("int") - 1, F.lit(0)))
    points = F.transform(at, lambda i: F.concat(plain(F.get(curve, 2 * i)), F.lit(", "), plain(F.get(curve, 2 * i + 1))))
    straight = F.array(F.lit("0, 0"), F.lit("255, 255"))
    drawn = F.when(F.size(curve) >= 4, F.concat(_sequence("ToneCurvePV2012", points), *[_sequence(f"ToneCurvePV2012{c}", straight) for c in ("Red", "Green", "Blue")])).otherwise("")
    return F.concat(F.lit(HEAD), F.array_join(attributes, " "), F.lit(">"), F.coalesce(drawn, F.lit("")), F.coalesce(look, F.lit("")), F.lit(TAIL))
