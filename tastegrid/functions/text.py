"""Names, templates and small parsers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\{(\w+)(?::(\d+))?\}")


def sanitized(x: Column) -> Column:
    """Characters that file names cannot hold, and white space, as single dashes; none at the ends."""
    dashed = F.regexp_replace(x, r'[\\/:*?"<>|\s]+', "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


#: Tokens of file-name templates whose values a picture's metadata tell, and those that are known without (fixed values).
CAPTURE_TOKENS = ("date", "time", "year", "month", "day", "camera", "lens")
OTHER_TOKENS = ("orig", "seq", "ext")
_NAMES = r"\{([a-zA-Z]+)(?::\d+)?\}"


def tokens(template: Column) -> Column:
    """The names of a template's tokens, in order; a null template has none."""
    return F.coalesce(F.regexp_extract_all(template, F.lit(_NAMES), 1), F.array().cast("array<string>"))


def needs_capture(template: Column) -> Column:
    """Whether a template has a token that only metadata can fill."""
    return F.arrays_overlap(tokens(template), F.array(*map(F.lit, CAPTURE_TOKENS)))


def problem(template: Column) -> Column:
    """What is wrong with a template: the first token that there is not, or that nothing is left of it; null if it is
    right."""
    known = F.array(*map(F.lit, (*CAPTURE_TOKENS, *OTHER_TOKENS)))
    unknown = F.filter(tokens(template), lambda t: ~F.array_contains(known, t))
    return F.when(F.coalesce(template, F.lit("")) == "", "the template gives an empty name").when(F.size(unknown) > 0, F.concat(F.lit("there is no token {"), F.get(unknown, 0), F.lit("}")))


def rendered(template: str, values: dict[str, Column], fallbacks: dict[str, str]) -> Column:
    """A file-name template: {token} or {token:width}. An unknown token is an error; an empty value falls back."""
    parts, at = [], 0
    for m in TOKEN.finditer(template):
        if m[1] not in values:
            raise ValueError(f"the template has no token {m[1]}")
        parts.append(F.lit(template[at : m.start()]))
        value = values[m[1]].cast("string")
        if m[2]:
            value = F.lpad(value, int(m[2]), "0")
        parts.append(F.coalesce(F.when(value != "", value), F.lit(fallbacks.get(m[1], ""))))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def version_key(x: Column) -> Column:
    """major, minor, patch as one comparable struct."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(x, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))


def parsed_size(x: Column, default: int) -> Column:
    """512MB and the like in bytes."""
    number = F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*$", 2))
    power = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    return F.coalesce(F.floor(number * power), F.lit(default).cast("long"))


def parsed_time(x: Column) -> Column:
    """Minutes of HH:MM, null where it is no time of day."""
    hour = F.regexp_extract(x, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int")
    minute = F.regexp_extract(x, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def human_bytes(x: Column) -> Column:
    one = lambda k, unit: F.concat((F.floor(x / k * 10 + 0.5) / 10).cast("string"), F.lit(unit))
    return F.when(x < 1024, F.concat(x.cast("string"), F.lit(" B"))).when(x < 2**20, one(2.0**10, " KB")).when(x < 2**30, one(2.0**20, " MB")).otherwise(one(2.0**30, " GB"))


def number_of(x: Column) -> Column:
    """A number from text: plain, or a rational a/b; null otherwise, or where b is 0."""
    top = F.regexp_extract(x, r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:/\s*([+-]?\d+(?:\.\d+)?))?\s*$", 1).try_cast("double")
    low = F.regexp_extract(x, r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:/\s*([+-]?\d+(?:\.\d+)?))?\s*$", 2).try_cast("double")
    return F.when(low.isNull(), top).when(low != 0, top / low)


def common_folder(paths: Column) -> Column:
    """The longest folder that all paths of an array are under."""
    parts = F.transform(paths, lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1))

    def shared(a: Column, b: Column) -> Column:
        lengths = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))
        return F.slice(a, F.lit(1), F.array_max(lengths))

    return F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, 0), shared), "/")
