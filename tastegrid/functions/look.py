"""The look of a frame: what six tone controls do to a histogram of log2 luminance, read as display percentiles.

A tone is a struct of exposure (stops) and contrast, highlights, shadows, whites, blacks (-1 to 1). `anchor` is the frame's
white in stops, taken before exposure. Everything here is a Column expression; `operators.tone` has the same in numpy for
searches, and a test holds one against the other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import smoothstep
from .jsmath import clamp

CONTROLS = ("exposure", "contrast", "highlights", "shadows", "whites", "blacks")
#: Percentiles that a look consists of (fixed values).
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Ranges of the controls, where they act against white, middle grey, and the contrast of the display (fixed values).
HIGHLIGHT_RANGE, SHADOW_RANGE, WHITE_STOPS, BLACK_STOPS, CONTRAST_RANGE = 0.55, 0.55, 1.1, 1.1, 0.45
HIGHLIGHT_PIVOT, SHADOW_PIVOT, GREY, MOST_STOPS = -3.2, -4.6, -2.4739, 4.0
WHITES, BLACKS = (-2.6, 0.2), (-7.5, -3.2)
DISPLAY_CONTRAST = 0.3
#: Bins of a stop, and the share of pixels below white.
BINS_PER_STOP, WHITE_SHARE = 16, 0.99
#: Settings as sliders tell them, by control, and how much one of the control's units is.
SLIDERS = {"exposure": ("Exposure2012", 1.0), "contrast": ("Contrast2012", 100.0), "highlights": ("Highlights2012", 100.0), "shadows": ("Shadows2012", 100.0), "whites": ("Whites2012", 100.0), "blacks": ("Blacks2012", 100.0)}


def tone_of(settings: Column) -> Column:
    """Sliders (a map) as a tone; a slider that is missing rests at 0."""
    return F.struct(*[(F.coalesce(F.try_element_at(settings, F.lit(name)), F.lit(0.0)) / unit).alias(c) for c, (name, unit) in SLIDERS.items()])


def sliders_of(tone: Column) -> Column:
    """A tone as a map of sliders."""
    return F.create_map(*[x for c, (name, unit) in SLIDERS.items() for x in (F.lit(name), tone[c] * unit)])


def shaped(stops: Column, anchor: Column, tone: Column) -> Column:
    """Log2 luminance after the controls."""
    lifted, white = stops + tone["exposure"], anchor + tone["exposure"]
    moved = tone["highlights"] * HIGHLIGHT_RANGE * clamp(lifted - (white + HIGHLIGHT_PIVOT), 0.0, MOST_STOPS)
    moved = moved + tone["shadows"] * SHADOW_RANGE * clamp(white + SHADOW_PIVOT - lifted, 0.0, MOST_STOPS)
    moved = moved + tone["whites"] * WHITE_STOPS * smoothstep(lifted - white, *WHITES)
    moved = moved + tone["blacks"] * BLACK_STOPS * (1 - smoothstep(lifted - white, *BLACKS))
    grey = white + GREY
    return grey + (lifted + moved - grey) * (1 + tone["contrast"] * CONTRAST_RANGE)


def displayed(log: Column) -> Column:
    """Log2 luminance as a display shows it, 0 to 1."""
    encoded = lambda y: F.when(y <= 0.0031308, y * 12.92).otherwise(F.pow(y, F.lit(1 / 2.4)) * 1.055 - 0.055)
    bent = lambda e: e + (e * e * (3 - 2 * e) - e) * DISPLAY_CONTRAST
    y = F.array(F.least(F.lit(1.0), F.pow(F.lit(2.0), log)))
    return F.transform(F.transform(y, encoded), bent)[0]


def percentiles(values: Column, weights: Column, ranks: tuple[float, ...] = PERCENTILES) -> Column:
    """Weighted lower percentiles, in the order of the values; null where nothing has weight."""
    both = F.array_sort(F.filter(F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w"))), lambda p: p["w"] > 0))

    def told(pairs: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("upto"))
        seen = F.aggregate(pairs, zero, lambda a, p: F.struct((a["sum"] + p["w"]).alias("sum"), F.array_append(a["upto"], a["sum"] + p["w"]).alias("upto")))

        def at(s: Column) -> Column:
            place = lambda r: F.size(F.filter(s["upto"], lambda u: u < s["sum"] * r - 1e-12))
            return F.when(F.size(pairs) > 0, F.array(*[F.get(pairs, F.least(place(r), F.size(pairs) - 1))["v"] for r in ranks]))

        return F.transform(F.array(seen), at)[0]

    return F.transform(F.array(both), told)[0]


def white(stops: Column, weights: Column) -> Column:
    """The anchor: where the share of white is reached."""
    return percentiles(stops, weights, (WHITE_SHARE,))[0]


def look_of(stops: Column, weights: Column, anchor: Column, tone: Column) -> Column:
    """The display percentiles of a histogram after the controls, in the order of what comes out, so controls that turn
    the order of tones around still give true percentiles."""
    return percentiles(F.transform(stops, lambda s: displayed(shaped(s, anchor, tone))), weights)


def distance(a: Column, b: Column) -> Column:
    """The mean difference of two looks, in 8-bit code values."""
    off = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(off, F.lit(0.0), lambda s, v: s + v) / F.size(a) * 255


#: A tile is the subject's if it is this sharp against the sharpest; what counts as clipped (fixed values).
SUBJECT_SHARE, CLIP_HIGH, CLIP_LOW = 0.5, 250 / 255, 5 / 255
REGIONS = ("subject", "background", "top", "bottom")


def regional(luma: Column, width: Column, height: Column, tiles: Column, cols: Column, rows: Column) -> Column:
    """A map region -> (mean, p05, p95, high, low) of luma (0 to 1, row by row): the subject, those tiles of a grid that
    are at least SUBJECT_SHARE as sharp as the sharpest, the rest, and the upper and lower third. An empty region is all
    zeros."""
    sharp = F.array_max(tiles) * SUBJECT_SHARE

    def figures(v: Column) -> Column:
        n = F.size(v)
        rank = lambda p: F.get(v, F.least(n - 1, F.floor(F.lit(p) * n).cast("int")))
        share = lambda keep: F.size(F.filter(v, keep)) / n
        told = F.struct((F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n).alias("mean"), rank(0.05).alias("p05"), rank(0.95).alias("p95"), share(lambda x: x >= CLIP_HIGH).alias("high"), share(lambda x: x <= CLIP_LOW).alias("low"))
        return F.when(n > 0, told).otherwise(F.struct(*[F.lit(0.0).alias(k) for k in ("mean", "p05", "p95", "high", "low")]))

    row = lambda i: F.floor(i / width)
    tile = lambda i: F.get(tiles, (F.least(rows - 1, F.floor(row(i) / height * rows)) * cols + F.least(cols - 1, F.floor((i % width) / width * cols))).cast("int"))
    where = {"subject": lambda i: tile(i) >= sharp, "background": lambda i: ~(tile(i) >= sharp), "top": lambda i: row(i) < height / 3, "bottom": lambda i: row(i) >= 2 * height / 3}
    part = lambda keep: F.transform(F.array(F.array_sort(F.filter(luma, lambda _, i: keep(i)))), figures)[0]
    return F.create_map(*[x for name in REGIONS for x in (F.lit(name), part(where[name]))])
