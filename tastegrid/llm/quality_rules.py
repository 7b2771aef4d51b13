"""Quality rules: counts of a text, and lines that too many documents of a host share.

Lines are normalised (lower case, white space to one space, trimmed) and hashed. For every host and line the
distinct documents are counted; exact copies of a text are one document. A line is boilerplate in a host if more
documents have it than its limit: share of the host's documents, but min_documents at least and most_documents at
most, so that small hosts have limits that can be met and large ones limits that boilerplate exceeds. Such a line is
removed from all but the document with the least doc_id, so one copy of every line stays. A document that is left
with less than min_left of its words is depleted and rejected, as is one that fails the base rules. DataFrame
functions only.

Cases: a null text counts as no text: all counts 0, base_failed true; a null host is a host of its own; a null doc_id
is an id that comes after all others; a document without a line above the limit keeps everything; a very long text is
one row, its lines are rows of their own; documents that tie for the least doc_id all keep the line; repeated rows
are judged alike; an empty table gives an empty result; extra columns pass through unless they carry an output name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound, fresh, words, written

#: Characters that count as symbols, and ASCII white space (fixed values).
SYMBOL, BLANK = r"[#*$%&|<>]", r"[\x20\x09-\x0D]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents of a host that may share a line: a share, within these bounds.
MIN_LINE_DOCUMENTS = 3
LINE_DOCUMENT_SHARE = 0.02
MOST_LINE_DOCUMENTS = 1000
#: Least share of a document's words that must be left.
MIN_LEFT = 0.3


def _windows(w: Column) -> Column:
    """A hash of each run of WINDOW words, from the words' own hashes."""
    at = F.sequence(F.lit(0), F.size(w) - WINDOW)
    runs = lambda h: F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) >= WINDOW, bound(F.transform(w, lambda x: F.xxhash64(x)), runs)).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column) -> Column:
    """Words in windows that are found twice or more. Windows are sorted by hash, so equal ones stand together;
    each window adds the words up to the next repeated one, WINDOW at most."""
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))
    starts = F.array_sort(F.transform(bound(ordered, again), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def text_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, grams, lines = fresh(docs, "_words", "_grams", "_lines")
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(w, words(F.col("text"))).withColumn(grams, _windows(F.col(w))).withColumn(lines, with_word)
    repeats = F.when(F.size(F.array_distinct(grams)) < F.size(grams), _covered(F.col(grams))).otherwise(0)
    # a value that Spark holds for indeterminate is not copied into filters above, which would count every word again
    as_counted = F.monotonically_increasing_id() >= 0
    out = out.withColumns({
        "n_words": F.when(as_counted, F.size(w)).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeats.cast("long"),
    }).drop(w, grams, lines)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, document, line, n) of each normalised line with a word: hashes of text and line, its words."""
    raw = docs.select("doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("document"), F.explode(F.split("text", "\n")).alias("raw"))
    clean = raw.withColumn("clean", _normal(F.col("raw"))).filter(F.col("clean") != "")
    return clean.select("doc_id", "host", "document", F.xxhash64("clean").alias("line"), (F.length("clean") - F.length(F.translate("clean", " ", "")) + 1).alias("n"))


def frequent_lines(docs: DataFrame, lines: DataFrame, host: str = "source", min_documents: int = MIN_LINE_DOCUMENTS, share: float = LINE_DOCUMENT_SHARE, most_documents: int = MOST_LINE_DOCUMENTS) -> DataFrame:
    """(host, line, n_documents, first) of the lines above their host's limit, first: the least doc_id with it. Each
    step is summed before its shuffle."""
    once = lines.groupBy("host", "line", "document").agg(F.min("doc_id").alias("first"))
    counts = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_documents"), F.min("first").alias("first")).filter(F.col("n_documents") > min_documents)
    hosts = docs.select(F.col(host).alias("in"), F.xxhash64("text").alias("document")).distinct().groupBy("in").agg(F.count(F.lit(1)).alias("of"))
    limit = F.greatest(F.lit(min_documents), F.least(F.lit(float(most_documents)), F.col("of") * share))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("in"))).filter(F.col("n_documents") > limit).select("host", "line", "n_documents", "first")


def _judged(docs: DataFrame, host: str, min_left: float, limits: dict) -> DataFrame:
    """text_counts with n_removed_words, kept and gone, the hashes of the lines to remove or null. The lines above
    the limits are few (each stands for more than min_documents documents); Spark broadcasts them where they are
    small and joins by shuffle where not. The lines are cut and hashed once and written to the shared folder."""
    lines = written(document_lines(docs, host), "lines")
    frequent = frequent_lines(docs, lines, host, **limits).toDF("h", "l", "n_documents", "first")
    hits = lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")) & ~F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    # per distinct (doc_id, text, host): repeated rows of one document add up their words as often as they stand
    removed = hits.groupBy("doc_id", "document", "host").agg(F.sum("n").alias("removed"), F.collect_set("line").alias("gone"))
    rows = docs.groupBy(F.col("doc_id").alias("i"), F.xxhash64("text").alias("d"), F.col(host).alias("h")).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)
    removed = removed.join(rows, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("document") == F.col("d")) & F.col("host").eqNullSafe(F.col("h")), "left")
    key, id, document, of, n_removed = fresh(docs, "_key", "_id", "_document", "_of", "_removed")
    removed = removed.select(F.col("doc_id").alias(id), F.col("document").alias(document), F.col("host").alias(of), (F.col("removed") / F.coalesce("times", F.lit(1))).cast("long").alias(n_removed), "gone")
    source = docs.drop("gone", "n_removed_words", "kept")
    counted = text_counts(source).withColumn(key, F.xxhash64("text"))
    out = counted.join(removed, F.col("doc_id").eqNullSafe(F.col(id)) & (F.col(key) == F.col(document)) & F.col(host).eqNullSafe(F.col(of)), "left")
    left = F.col("n_words") - F.coalesce(n_removed, F.lit(0))
    depleted = left < F.col("n_words") * min_left
    return out.withColumn("n_removed_words", F.coalesce(n_removed, F.lit(0)).cast("long")).withColumn("kept", ~F.col("base_failed") & ~depleted).drop(key, id, document, of, n_removed)


def judged(docs: DataFrame, host: str = "source", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """text_counts with n_removed_words and kept."""
    return _judged(docs, host, min_left, limits).drop("gone")


def cleaned(docs: DataFrame, host: str = "source", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """The kept rows of docs, text without the removed lines; n_chars, where docs have it, is the new text's length.
    The other lines stay as they are, in their order; a text without a removed line is passed on untouched."""
    (own,) = fresh(docs, "_own")
    top = [c for c in docs.columns if c in ("doc_id", "text", "n_chars", host)]
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in top]
    # the other columns ride in one, whatever their names
    out = _judged(docs.select(*top, F.struct(*rest, F.lit(None).alias(own)).alias(own)), host, min_left, limits).filter("kept")
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(_normal(x))))
    changed = F.col("gone").isNotNull()
    out = out.withColumn("text", F.when(changed, F.array_join(left, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(c) if c in top else F.col(own)[c].alias(c) for c in docs.columns])
