"""Judgements and merges over a library's rows: edits, treatments, verdicts, stars, stored results, tags, syncs, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edited(values: Column, neutral: dict[str, float], *, treatment: Column | None = None, white_balance: Column | None = None) -> Column:
    """Whether a frame was edited: a value of the map off its neutral one (0 where neutral names none), a treatment or a
    white balance that is set. Absent values are neutral."""
    rest = F.lit(0.0)
    at = lambda k: reduce(lambda e, kv: F.when(k == kv[0], F.lit(float(kv[1]))).otherwise(e), neutral.items(), rest)
    out = F.coalesce(F.exists(F.map_entries(values), lambda e: e["value"].isNotNull() & (e["value"] != at(e["key"]))), F.lit(False))
    for flag in (treatment, white_balance):
        if flag is not None:
            out = out | F.coalesce(flag, F.lit(False))
    return out


def treatment(flag: Column, keys: Column, prefixes: tuple[str, ...]) -> Column:
    """bw or color: an explicit flag wins both ways, else any key of the groups that only black and white has."""
    marked = F.exists(keys, lambda k: reduce(lambda a, b: a | b, [k.startswith(p) for p in prefixes]))
    return F.coalesce(flag, F.when(marked, "bw"), F.lit("color"))


def verdict(score: Column, peak: Column, threshold: float = 100.0, rescue: float = 250.0) -> Column:
    """soft below the threshold; a soft frame whose peak reaches the rescue level is kept."""
    return F.when(score >= threshold, "sharp").when(peak >= rescue, "rescued").otherwise("soft")


def stars(merit: Column, focus: Column, cuts: tuple[tuple[float, int], ...], reject: float, soft: float, soft_cap: int) -> Column:
    """The stars of the first cut-off that merit reaches; 0 below the reject focus, at most soft_cap below soft."""
    by_merit = F.lit(0)
    for least, n in sorted(cuts):
        by_merit = F.when(merit >= least, n).otherwise(by_merit)
    return F.when(focus < reject, 0).when(focus < soft, F.least(by_merit, F.lit(soft_cap))).otherwise(by_merit)


def valid_results(files: DataFrame, results: DataFrame, key: str, identity: list[str], values: list[str]) -> DataFrame:
    """files with the values of results that are theirs: key and identity (size, time) must be the same; else null."""
    r = results.select(*[F.col(c).alias(f"_r_{c}") for c in (key, *identity)], *values)
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_r_{c}") for c in (key, *identity)])
    return files.join(r, same, "left").drop(*[f"_r_{c}" for c in (key, *identity)])


def preserved(template: Column, kept: Column) -> Column:
    """A map of tags: what was read back before a rewrite wins over the template; null values do not count."""
    there = F.coalesce(F.map_filter(kept, lambda k, v: v.isNotNull()), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_concat(F.map_filter(template, lambda k, v: ~F.map_contains_key(there, k)), there)


def merged_tags(tags: Column, single: dict[str, Column], added: Column) -> Column:
    """Sorted tags: of a family that has one tag (by prefix) the new one replaces the old, null removes it; added tags
    come in in lower case, once each."""
    old = F.coalesce(tags, F.array().cast("array<string>"))
    for prefix, value in single.items():
        old = F.filter(old, lambda t: ~t.startswith(prefix))  # noqa: B023
        old = F.array_compact(F.array_append(old, F.when(value.isNotNull(), F.concat(F.lit(prefix), value))))
    return F.array_sort(F.array_union(old, F.transform(F.coalesce(added, F.array().cast("array<string>")), lambda t: F.lower(t))))


def reconciled(base: DataFrame, reports: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with each field that the other side reports, and changed. reports: key, and per field f what it reports (f),
    what was last sent to it (sent_f); what merely echoes what was sent is no change, nor is a null."""
    r = reports.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for f in fields for c in (f, f"sent_{f}")])
    joined, any_ = base.join(r, F.col(key).eqNullSafe(F.col("_key")), "left"), F.lit(False)
    out = {}
    for f in fields:
        taken = F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f"_sent_{f}"))
        any_, out[f] = any_ | taken, F.when(taken, F.col(f"_{f}")).otherwise(F.col(f))
    return joined.withColumn("changed", any_).withColumns(out).select(*base.columns, "changed")


def refine_verdict(*, complete: Column, there: Column, n: Column, least: int, print_now: Column, print_then: Column) -> Column:
    """Why a session is passed over, the first reason that applies, or that it is due."""
    return F.when(~complete, "incomplete").when(~there, "gone").when(n < least, "empty").when(print_then == print_now, "unchanged").otherwise("due")


def unique_names(files: DataFrame, name: str, order: list[Column], extension: str = "", taken: DataFrame | None = None) -> DataFrame:
    """files with name made unique, upper and lower case alike: in order, the first that asks for a name has it, the rest
    get _2, _3 and so on, passing over names that others ask for or that stand in taken (name). A name's rows are
    ordered together; names meet only with the few that look like their own with a number."""
    low = lambda c: F.lower(F.concat(c, F.lit(extension)))
    nth = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    numbered = files.withColumn("_nth", nth).withColumn("_low", F.lower(name))
    # numbers that are in use: names of the form stem_k that stand as they are, in the batch or on disk
    literal = numbered.filter("_nth = 1").select(low(F.col(name)).alias("_full"))
    if taken is not None:
        literal = literal.unionByName(taken.select(F.lower("name").alias("_full")))
    tail = F.regexp_extract("_full", r"^(.*)_([1-9][0-9]*)" + extension.replace(".", r"\.").lower() + "$", 0)
    stem, number = (F.regexp_extract("_full", r"^(.*)_([1-9][0-9]*)" + extension.replace(".", r"\.").lower() + "$", i) for i in (1, 2))
    used = literal.filter(tail != "").select(stem.alias("_stem"), number.cast("int").alias("_k")).filter("_k >= 2").groupBy("_stem").agg(F.array_sort(F.collect_set("_k")).alias("_used"))
    free = numbered.join(used, F.col("_low") == F.col("_stem"), "left")
    if taken is not None:
        there = taken.select(F.lower("name").alias("_there")).distinct()
        free = free.join(there, low(F.col(name)) == F.col("_there"), "left").withColumn("_shift", F.when(F.col("_there").isNotNull(), 1).otherwise(0)).drop("_there")
    else:
        free = free.withColumn("_shift", F.lit(0))
    place = F.col("_nth") + F.col("_shift")
    # the place-th number from 2 on that is not in use
    number = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), place, lambda a, u: F.when(u <= a, a + 1).otherwise(a))
    return free.withColumn(name, F.concat(name, F.when(place > 1, F.concat(F.lit("_"), number)).otherwise(""), F.lit(extension))).drop("_nth", "_low", "_stem", "_used", "_shift")
