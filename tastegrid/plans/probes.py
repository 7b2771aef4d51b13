"""Queries of probes, and of catalogue exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import documents
from ..operators import probes, sidecars
from ..registry import query
from ..sources import catalogs
from ..sources.shared import shared_dir
from .base import OBSERVED, frames, observed, table

_KS = (0, 1, 2, 4)


@query("calibration_curve", f"""WITH {OBSERVED}, o AS (SELECT file, session, predicted AS p, actual AS y, 140000.0 AS c FROM observed),
  b AS (SELECT session, count(*) AS n, avg(y - p) AS m, var_pop(y - p) * count(*) AS within, sum(y - p) AS s FROM o GROUP BY 1 HAVING count(*) > 1),
  w AS (SELECT sum(within) / sum(n) AS within, sum(s) / sum(n) AS grand, avg(n) AS n FROM b), v AS (SELECT within / greatest(1e-9, (SELECT avg((m - grand) * (m - grand)) FROM b) - within / n) AS kappa FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY md5(file::VARCHAR), file) AS place, count(*) OVER (PARTITION BY session) AS n FROM o),
  k AS (SELECT unnest({list(_KS)}) AS k), s AS (SELECT session, k, avg(y - p) AS off, avg(y) AS mean FROM r, k WHERE place <= k GROUP BY 1, 2),
  e AS (SELECT k.k, y, p, c, off, mean, k.k / (k.k + kappa) AS share FROM r, k, v LEFT JOIN s ON s.session = r.session AND s.k = k.k WHERE place > k.k AND n >= k.k + 2),
  a AS (SELECT k, count(*) AS n, avg(abs(c - y)) AS e0, avg(abs(p - y)) AS e1, avg(abs(mean - y)) AS e2, avg(abs(p + off - y)) AS e3, avg(abs(p + share * off - y)) AS e4 FROM e GROUP BY 1),
  l AS (SELECT k, n, unnest({list(probes.METHODS)}) AS method, unnest([e0, e1, e2, e3, e4]) AS mae FROM a) SELECT k::INT AS k, 0 AS target, n, method, floor(mae * 100 + 0.501) / 100 AS mae FROM l WHERE mae IS NOT NULL""")
def calibration_curve(spark, sf_dir):
    """Errors of five estimators of an order's total when 0 to 4 orders of its customer are known."""
    o = observed(spark, sf_dir).select("file", "session", F.array("predicted").alias("p"), F.array("actual").alias("y"), F.array(F.lit(140000.0)).alias("c"))
    found = probes.calibration_curve(o, "file", "session", "p", "y", "c", _KS)
    return found.select("k", "target", "n", "method", (F.floor(F.col("mae") * 100 + 0.501) / 100).alias("mae"))


@query("treatment_transfer")
def treatment_transfer(spark, sf_dir):
    """What frames of one return flag tell of the frames of another, beside their supplier's mean."""
    f = frames(spark, sf_dir)
    x, y = F.array("l_quantity", F.col("l_tax") * 100), F.array(F.col("l_extendedprice") / 1000, F.col("l_discount") * 100)
    rows = probes.treatment_transfer(f.select("l_returnflag", "session", x.alias("x"), y.alias("y")), "l_returnflag", "session", "x", "y")
    return spark.createDataFrame(rows, "trained_on string, tried_on string, target int, mae double, skill double")


@query("catalog_read", """SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_size / 10.0::DOUBLE END AS exposure, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE END AS monochrome,
  CASE WHEN p_partkey % 11 <> 0 THEN (4000 + p_size)::DOUBLE END AS temperature, (SELECT count(*) FROM part WHERE p_partkey % 11 = 0) AS n_bad FROM part""")
def catalog_read(spark, sf_dir):
    """Exports written a brand each and read again: settings by file, whatever the case of its path; entries without
    settings told."""
    p = table(spark, sf_dir, "part")
    settings = {"Exposure2012": F.col("p_size") / 10, "ConvertToGrayscale": F.col("p_size") % 2 == 0, "Temperature": 4000 + F.col("p_size"), "ToneCurvePV2012": F.array(F.lit(0), F.lit(255))}
    photo = documents.written({"path": F.concat(F.lit("/Cat/"), F.upper("p_name"), F.lit("//"), "p_partkey", F.lit(".RAW")), "settings": F.when(F.col("p_partkey") % 11 != 0, documents.written(settings))})
    export = documents.written({"version": F.lit(catalogs.VERSION), "folder": F.col("p_brand"), "photos": F.col("photos")})
    folder = f"{shared_dir(spark)}/catalogs-{uuid.uuid4().hex}"
    p.groupBy("p_brand").agg(F.collect_list(photo).alias("photos")).select(F.to_json(export).alias("value"), F.row_number().over(_by_brand()).alias("n")).write.partitionBy("n").text(folder)
    found = catalogs.photos(spark, f"{folder}/*")
    files = p.select("p_partkey", F.concat(F.lit("/cat/"), F.lower("p_name"), F.lit("/"), "p_partkey", F.lit(".raw")).alias("path"))
    m = catalogs.matched(files, found).withColumn("m", sidecars.ingested(catalogs.record(F.col("settings"))))
    bad = found.filter("bad IS NOT NULL").agg(F.count(F.lit(1)).alias("n_bad"))
    of = lambda name: F.try_element_at("m", F.lit(name))
    return m.select("p_partkey", of("Exposure2012").alias("exposure"), of("ConvertToGrayscale").alias("monochrome"), of("Temperature").alias("temperature")).crossJoin(F.broadcast(bad))


def _by_brand():
    from pyspark.sql.window import Window

    return Window.orderBy("p_brand")  # a row per brand
