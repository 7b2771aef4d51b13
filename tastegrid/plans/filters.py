"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import version_key
from ..operators import library
from ..operators.feedback import in_sample
from ..registry import query
from .base import FRAMES, PARAMS, frames, params, table

#: File kinds by extension (fixed values).
RAW = ("arw", "cr2", "cr3", "crw", "dng", "erf", "fff", "iiq", "k25", "kdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "sr2", "srw", "x3f")
PROCESSED = ("heic", "jpeg", "jpg", "png", "tif", "tiff")
EXTENSIONS = ("arw", "jpg", "txt", "nef", "png", "xmp", "dng")


def extension_kind(ext):
    """raw, processed, or null."""
    return F.when(F.lower(ext).isin(*RAW), "raw").when(F.lower(ext).isin(*PROCESSED), "processed")


@query("classify_ext", f"""
  WITH files AS (SELECT p_partkey, [{','.join(f"'{e}'" for e in EXTENSIONS)}][(p_partkey % 7)::INT + 1] AS ext FROM part)
  SELECT p_partkey, ext, CASE WHEN lower(ext) IN {RAW} THEN 'raw' WHEN lower(ext) IN {PROCESSED} THEN 'processed' END AS kind FROM files""")
def classify_ext(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", ext.alias("ext")).withColumn("kind", extension_kind(F.col("ext")))


@query("usable_rows", "SELECT vec_id, len(embedding) AS width FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def usable_rows(spark, sf_dir):
    """Rows with a vector that is not empty."""
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0).select("vec_id", F.size("embedding").cast("long").alias("width"))


@query("training_rows", "SELECT event_id, user_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND (CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END) IS DISTINCT FROM false")
def training_rows(spark, sf_dir):
    """Rows with at least one target that are not marked unedited; an unknown mark passes."""
    e = table(spark, sf_dir, "events").withColumn("targets", F.from_json("props", "map<string,double>")).withColumn("edited", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0))
    return e.filter((F.size(F.map_keys("targets")) > 0) & ~F.col("edited").eqNullSafe(F.lit(False))).select("event_id", "user_id")


@query("is_edited", f"WITH {FRAMES} SELECT file, (l_discount <> 0 OR l_tax <> 0 OR l_returnflag <> 'N') AS edited FROM frames")
def is_edited(spark, sf_dir):
    """Whether any parameter is off its neutral value, or the treatment or white balance was set."""
    values = F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"))
    return frames(spark, sf_dir).select("file", library.edited(values, {}, treatment=F.col("l_returnflag") != "N").alias("edited"))


@query("treatment", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'bw' WHEN event_id % 5 = 1 THEN 'color' WHEN (json_extract(props, '$.k'))::INT >= 50 THEN 'bw' ELSE 'color' END AS treatment FROM events""")
def treatment(spark, sf_dir):
    """An explicit flag wins both ways; else a key of the mixer group makes it black and white."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    keys = F.map_keys(F.when(k >= 50, F.create_map(F.lit("mixer_red"), k)).otherwise(F.create_map(F.lit("exposure"), k)))
    flag = F.when(F.col("event_id") % 5 == 0, "bw").when(F.col("event_id") % 5 == 1, "color")
    return e.select("event_id", library.treatment(flag, keys, ("mixer_",)).alias("treatment"))


@query("never_seen", f"WITH {PARAMS}, dims AS (SELECT unnest(['quantity','price','discount','tax','tint','hue']) AS param) SELECT param FROM dims WHERE param NOT IN (SELECT DISTINCT param FROM params)")
def never_seen(spark, sf_dir):
    """Parameters that no row has."""
    dims = spark.createDataFrame([(p,) for p in ("quantity", "price", "discount", "tax", "tint", "hue")], "param string")
    return dims.join(params(spark, sf_dir).select("param").distinct(), "param", "left_anti")


@query("cull_verdict", f"WITH {FRAMES} SELECT file, CASE WHEN l_quantity * 4 >= 100 THEN 'sharp' WHEN l_extendedprice / 100 >= 250 THEN 'rescued' ELSE 'soft' END AS verdict FROM frames")
def cull_verdict(spark, sf_dir):
    return frames(spark, sf_dir).select("file", library.verdict(F.col("l_quantity") * 4, F.col("l_extendedprice") / 100).alias("verdict"))


@query("star_rating", f"""WITH {FRAMES}, m AS (SELECT file, l_quantity / 50 AS merit, l_extendedprice / 1000 AS focus FROM frames),
  s AS (SELECT *, CASE WHEN merit >= 0.9 THEN 5 WHEN merit >= 0.7 THEN 4 WHEN merit >= 0.5 THEN 3 WHEN merit >= 0.3 THEN 2 WHEN merit >= 0.1 THEN 1 ELSE 0 END AS by_merit FROM m)
  SELECT file, CASE WHEN focus < 5 THEN 0 WHEN focus < 20 THEN least(by_merit, 3) ELSE by_merit END AS stars FROM s""")
def star_rating(spark, sf_dir):
    cuts = ((0.9, 5), (0.7, 4), (0.5, 3), (0.3, 2), (0.1, 1))
    return frames(spark, sf_dir).select("file", library.stars(F.col("l_quantity") / 50, F.col("l_extendedprice") / 1000, cuts, 5, 20, 3).alias("stars"))


@query("library_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 1000) AND o_orderpriority IN ('1-URGENT','2-HIGH')")
def library_filter(spark, sf_dir):
    """Picks that are not rejected, with one of two labels."""
    picks, rejected, label = F.col("o_orderstatus") == "F", F.col("o_totalprice") < 1000, F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").filter(picks & ~rejected & label.isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("held_out", """WITH x AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id * 7 % 100 END AS p, CASE WHEN event_id % 6 <> 0 THEN 50 END AS t, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS stored FROM events)
  SELECT event_id FROM x WHERE NOT (CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN NOT (p > t) ELSE coalesce(stored, false) END)""")
def held_out(spark, sf_dir):
    e = F.col("event_id")
    p, t, stored = F.when(e % 4 != 0, e * 7 % 100), F.when(e % 6 != 0, 50), F.when(e % 3 == 0, e % 2 == 0)
    return table(spark, sf_dir, "events").filter(~in_sample(p, t, stored)).select("event_id")


@query("pending_marks", "SELECT page_id, url FROM pages WHERE (starts_with(url, 'https://www') OR url = 'https://www') AND page_id % 4 <> 0")
def pending_marks(spark, sf_dir):
    """Marks under a prefix that are not applied yet, or were applied to another sidecar."""
    return table(spark, sf_dir, "pages").filter((F.col("url").startswith("https://www") | (F.col("url") == "https://www")) & (F.col("page_id") % 4 != 0)).select("page_id", "url")


@query("mask_features", f"WITH {FRAMES} SELECT file, l_quantity AS a, 0.0::DOUBLE AS b, l_discount AS c, 0.0::DOUBLE AS d FROM frames")
def mask_features(spark, sf_dir):
    """The columns that a parameter group may not read are zero."""
    vector = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    kept = arrays.masked(vector, [True, False, True, False])
    return frames(spark, sf_dir).select("file", kept.alias("m")).select("file", *[F.get("m", i).alias(n) for i, n in enumerate("abcd")])


@query("marks_patch", """SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT','BIGINT') AND (json_extract(props, '$.k'))::INT BETWEEN 0 AND 5 THEN (json_extract(props, '$.k'))::INT END AS stars,
  json_extract(props, '$.k') IS NOT NULL AND NOT (json_extract(props, '$.k'))::INT BETWEEN 0 AND 5 AS refused FROM events""")
def marks_patch(spark, sf_dir):
    """Known fields of the right type and range; the rest is refused."""
    patch = F.from_json("props", "struct<k:int>")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.when(patch.between(0, 5), patch).alias("stars"), (patch.isNotNull() & ~patch.between(0, 5)).alias("refused"))


@query("semver_range", """WITH v AS (SELECT p_partkey, (p_partkey % 3) || '.' || (p_partkey % 11) || '.' || (p_partkey % 7) AS version FROM part)
  SELECT p_partkey, version FROM v WHERE (p_partkey % 3) * 10000 + (p_partkey % 11) * 100 + p_partkey % 7 > 903 AND (p_partkey % 3) * 10000 + (p_partkey % 11) * 100 + p_partkey % 7 < 11003""")
def semver_range(spark, sf_dir):
    """Versions after one and up to another."""
    k = F.col("p_partkey")
    v = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", k % 3, k % 11, k % 7).alias("version"))
    key = version_key(F.col("version"))
    return v.filter((key > version_key(F.lit("0.9.3"))) & (key <= version_key(F.lit("1.10.2"))))
