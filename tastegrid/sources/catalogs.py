"""Catalogue exports: JSON documents of one folder each, {version, folder, found, roots, photos: [{path, settings}]}.

Files are read as wholes by Spark's own reader, so an export may lie in any store; one has to fit a task, as it has to
fit the editor that wrote it. Photos are rows; those without a path or settings are told beside them, not lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents

VERSION = 1


def _checked(text: Column) -> Column:
    """The document of an export, or an error that says why it is none."""
    doc = documents.parsed(text)
    version = documents.number(doc, "version")
    photos = documents.part(doc, "photos").try_cast("array<variant>")
    fail = lambda *said: F.raise_error(F.concat(*said)).cast("variant")
    return (
        F.when(doc.isNull(), fail(F.lit("the catalogue export is not valid JSON")))
        .when(photos.isNull(), fail(F.lit("the catalogue export has no photos")))
        .when(version.isNull() | (version != VERSION), fail(F.lit("the catalogue export is version "), F.coalesce(F.to_json(documents.part(doc, "version")), F.lit("none")), F.lit(f"; this reads version {VERSION}")))
        .otherwise(doc)
    )


def exports(spark: SparkSession, *paths: str) -> DataFrame:
    """A row per export: source, folder, found (false where the catalogue has no such folder), roots, doc. An export that
    is none, or of another version, raises when it is read."""
    read = spark.read.option("wholetext", True).text(list(paths)).select(F.input_file_name().alias("source"), _checked(F.col("value")).alias("doc"))
    roots = F.filter(F.transform(documents.part(F.col("doc"), "roots").try_cast("array<variant>"), lambda r: F.when(F.schema_of_variant(r) == "STRING", F.try_variant_get(r, "$", "string"))), lambda r: r.isNotNull())
    found = F.coalesce(F.try_variant_get(F.col("doc"), "$.found", "boolean"), F.lit(True))
    return read.select("source", F.coalesce(documents.text(F.col("doc"), "folder"), F.lit("")).alias("folder"), found.alias("found"), F.coalesce(roots, F.array().cast("array<string>")).alias("roots"), "doc")


def photos(spark: SparkSession, *paths: str) -> DataFrame:
    """A row per photo: source, folder, path, settings (a document), and bad: the entry as it stands, where it has no path
    or no settings, with path and settings null."""
    each = exports(spark, *paths).select("source", "folder", F.explode(documents.part(F.col("doc"), "photos").try_cast("array<variant>")).alias("photo"))
    path, settings = documents.text(F.col("photo"), "path"), documents.part(F.col("photo"), "settings")
    good = F.coalesce(path.isNotNull() & documents.is_object(settings), F.lit(False))
    return each.select("source", "folder", F.when(good, path).alias("path"), F.when(good, settings).alias("settings"), F.when(~good, F.to_json("photo")).alias("bad"))


def record(settings: Column) -> Column:
    """Settings as a metadata reader's record, JSON of texts: lists are joined by commas, objects are left out."""
    def text(v: Column) -> Column:
        items = F.transform(v.try_cast("array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
        return F.when(documents.is_object(v), F.lit(None).cast("string")).when(items.isNotNull(), F.array_join(items, ", ")).otherwise(F.try_variant_get(v, "$", "string"))

    told = F.transform_values(settings.try_cast("map<string,variant>"), lambda _, v: text(v))
    return F.to_json(F.map_filter(told, lambda _, v: v.isNotNull()))


def folded(path: Column, case: bool = True) -> Column:
    """A path as it is looked up: slashes one way, no doubled or trailing ones, no '.' parts, and small letters where case
    does not count."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(\.?/)+", "/"), r"(?<=.)/\.?$", "")
    return plain if case else F.lower(plain)


def matched(files: DataFrame, found: DataFrame, path: str = "path", *, case: bool = False) -> DataFrame:
    """files with settings from a catalogue's photos, null where it has none. Of photos with one path the last source
    counts."""
    best = found.filter("bad IS NULL").groupBy(folded(F.col("path"), case).alias("_path")).agg(F.max_by("settings", F.col("source")).alias("settings"))
    return files.join(best, folded(F.col(path), case) == F.col("_path"), "left").drop("_path")
