"""Colour and tone arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsmath import clamp, or_else


def srgb_encoded(x: Column) -> Column:
    """Linear light to the sRGB curve."""
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - t * 2.0)


def planckian_xy(kelvin: Column) -> tuple[Column, Column]:
    """Chromaticity of a black body between 1667 and 25000 K, by the usual cubic fit (fixed values)."""
    t = clamp(kelvin, 1667.0, 25000.0)
    x = F.when(t <= 4000, -0.2661239e9 / (t * t * t) - 0.2343589e6 / (t * t) + 0.8776956e3 / t + 0.179910).otherwise(-3.0258469e9 / (t * t * t) + 2.1070379e6 / (t * t) + 0.2226347e3 / t + 0.240390)
    cube, square = x * x * x, x * x
    y = (
        F.when(t <= 2222, cube * -1.1063814 - square * 1.34811020 + x * 2.18555832 - 0.20219683)
        .when(t <= 4000, cube * -0.9549476 - square * 1.37418593 + x * 2.09137015 - 0.16748867)
        .otherwise(cube * 3.0817580 - square * 5.87338670 + x * 3.75112997 - 0.37001483)
    )
    return x, y


def balance_gains(kelvin: Column) -> Column:
    """Channel gains that make a black body's light neutral, scaled to unit luminance."""
    x, y = planckian_xy(kelvin)
    big_x, big_z = x / y, (1 - x - y) / y
    rgb = [big_x * 3.2406 - 1.5372 - big_z * 0.4986, big_x * -0.9689 + 1.8758 + big_z * 0.0415, big_x * 0.0557 - 0.2040 + big_z * 1.0570]
    gains = [1 / F.greatest(c, F.lit(1e-6)) for c in rgb]
    luminance = gains[0] * 0.2126 + gains[1] * 0.7152 + gains[2] * 0.0722
    return F.array(*[g / luminance for g in gains])


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation, value, of channels from 0 to 1; grey has hue 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    hue = F.when(span == 0, 0.0).otherwise(F.pmod(sector * 60, F.lit(360.0)))
    return F.struct(hue.alias("hue"), F.when(top == 0, 0.0).otherwise(span / top).alias("saturation"), top.alias("value"))


def shaped_log(stops: Column, exposure: Column, contrast: Column, highlights: Column, shadows: Column) -> Column:
    """Log2 luminance after tone controls: contrast about middle grey, highlights above it, shadows below."""
    lifted = stops + exposure
    spread = lifted * (1 + contrast)
    return spread + highlights * smoothstep(spread, 0.0, 4.0) + shadows * (1.0 - smoothstep(spread, -4.0, 0.0))


def mired(kelvin: Column) -> Column:
    return 1e6 / or_else(kelvin, 1.0)
