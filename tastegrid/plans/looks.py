"""Queries of looks: percentiles after tone controls, regions, the solvers, intents, looks from features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import look
from ..operators import looks, tone
from ..registry import query
from .base import r6, spread, table

#: What an embedding stands for here: its components as stops of a histogram, weights that repeat, two parts of the frame.
_STOPS = "list_transform(embedding, lambda x: x::DOUBLE * 16 - 4)"


def histograms(spark, sf_dir):
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    stops, weights = F.transform("embedding", lambda x: x.cast("double") * 16 - 4), F.transform("embedding", lambda _, i: (1 + i % 3).cast("double"))
    side = lambda keep: F.transform("weights", lambda w, i: F.when(keep(i), w).otherwise(0.0))
    h = e.select(F.col("vec_id"), F.col("label"), stops.alias("stops"), weights.alias("weights"))
    h = h.withColumn("anchor", look.white(F.col("stops"), F.col("weights")))
    return h.withColumn("regions", F.create_map(F.lit("sky"), side(lambda i: i < 16), F.lit("subject"), side(lambda i: i >= 48)))


def _tone():
    v = F.col("vec_id")
    part = lambda n, by: (v % n - n // 2) / by
    return F.struct(*[x.alias(c) for c, x in zip(look.CONTROLS, (part(5, 4.0), part(3, 1.0), part(7, 3.0), part(9, 4.0), part(4, 2.0), part(6, 3.0)), strict=True)])


def _steps(x: str, low: float, high: float) -> str:
    t = f"least(1, greatest(0, ({x} - {low}) / ({high} - {low})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


_RANKS = ", ".join(f"min(CASE WHEN upto >= total * {p} - 1e-12 THEN v END)" for p in look.PERCENTILES)


@query("look_of", f"""WITH x AS (SELECT vec_id, unnest({_STOPS}) AS s, unnest(range(64)) % 3 + 1.0::DOUBLE AS w FROM embeddings),
  a AS (SELECT vec_id, min(s) AS anchor FROM (SELECT vec_id, s, sum(w) OVER (PARTITION BY vec_id ORDER BY s) AS upto, sum(w) OVER (PARTITION BY vec_id) AS total FROM x) WHERE upto >= total * {look.WHITE_SHARE} - 1e-12 GROUP BY 1),
  t AS (SELECT x.*, anchor + (vec_id % 5 - 2) / 4.0::DOUBLE AS white, s + (vec_id % 5 - 2) / 4.0::DOUBLE AS l, (vec_id % 3 - 1) / 1.0::DOUBLE AS c, (vec_id % 7 - 3) / 3.0::DOUBLE AS hi, (vec_id % 9 - 4) / 4.0::DOUBLE AS sh, (vec_id % 4 - 2) / 2.0::DOUBLE AS wh, (vec_id % 6 - 3) / 3.0::DOUBLE AS bl FROM x JOIN a USING (vec_id)),
  d AS (SELECT *, l + hi * {look.HIGHLIGHT_RANGE} * least(greatest(l - (white + {look.HIGHLIGHT_PIVOT}), 0), 4) + sh * {look.SHADOW_RANGE} * least(greatest(white + {look.SHADOW_PIVOT} - l, 0), 4) + wh * {look.WHITE_STOPS} * {_steps('(l - white)', *look.WHITES)} + bl * {look.BLACK_STOPS} * (1 - {_steps('(l - white)', *look.BLACKS)}) AS m, white + {look.GREY} AS grey FROM t),
  y AS (SELECT vec_id, w, least(1, pow(2, grey + (m - grey) * (1 + c * {look.CONTRAST_RANGE}))) AS y FROM d), e AS (SELECT vec_id, w, CASE WHEN y <= 0.0031308 THEN y * 12.92 ELSE pow(y, 1 / 2.4::DOUBLE) * 1.055 - 0.055 END AS e FROM y),
  v AS (SELECT vec_id, w, floor((e + (e * e * (3 - 2 * e) - e) * {look.DISPLAY_CONTRAST}) * 1e6 + 0.501) / 1e6 AS v FROM e), u AS (SELECT vec_id, v, sum(w) OVER (PARTITION BY vec_id ORDER BY v) AS upto, sum(w) OVER (PARTITION BY vec_id) AS total FROM v)
  SELECT vec_id, [{_RANKS}] AS look FROM u GROUP BY 1""")
def look_of(spark, sf_dir):
    """The look of each histogram under six controls."""
    h = histograms(spark, sf_dir).withColumn("tone", _tone())
    return h.select("vec_id", F.transform(look.look_of(F.col("stops"), F.col("weights"), F.col("anchor"), F.col("tone")), r6).alias("look"))


@query("regional_luma", f"""WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: least(1, greatest(0, x::DOUBLE * 3 + 0.5)))) AS l, list_transform(embedding[1:16], lambda x: abs(x::DOUBLE)) AS tiles FROM embeddings),
  p AS (SELECT vec_id, i, l, tiles[(i // 8 // 2) * 4 + (i % 8) // 2 + 1] >= {look.SUBJECT_SHARE} * list_max(tiles) AS sharp FROM x),
  r AS (SELECT vec_id, 'subject' AS region, l FROM p WHERE sharp UNION ALL SELECT vec_id, 'background', l FROM p WHERE NOT sharp UNION ALL SELECT vec_id, 'top', l FROM p WHERE i // 8 < 8 / 3.0 UNION ALL SELECT vec_id, 'bottom', l FROM p WHERE i // 8 >= 16 / 3.0),
  s AS (SELECT vec_id, region, list(l ORDER BY l) AS v FROM r GROUP BY 1, 2)
  SELECT e.vec_id, g.region, coalesce(floor(list_avg(v) * 1e6 + 0.501) / 1e6, 0) AS mean, coalesce(v[least(len(v), floor(0.05 * len(v))::INT + 1)], 0) AS p05, coalesce(v[least(len(v), floor(0.95 * len(v))::INT + 1)], 0) AS p95, coalesce(len(list_filter(v, lambda x: x >= {look.CLIP_HIGH})) / len(v), 0) AS high, coalesce(len(list_filter(v, lambda x: x <= {look.CLIP_LOW})) / len(v), 0) AS low
  FROM embeddings e CROSS JOIN (SELECT unnest(['subject', 'background', 'top', 'bottom']) AS region) g LEFT JOIN s ON s.vec_id = e.vec_id AND s.region = g.region""")
def regional_luma(spark, sf_dir):
    """Luma of the subject, what is around it, and the upper and lower third."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double") * 3 + 0.5))).alias("luma"), F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x.cast("double"))).alias("tiles"))
    side, grid = F.lit(8), F.lit(4)
    r = e.select("vec_id", F.explode(look.regional(F.col("luma"), side, side, F.col("tiles"), grid, grid)).alias("region", "f"))
    return r.select("vec_id", "region", r6(F.col("f.mean")).alias("mean"), *[F.col("f")[k].alias(k) for k in ("p05", "p95", "high", "low")])


def _neutral():
    return F.struct(*[F.lit(0.0).alias(c) for c in look.CONTROLS])


@query("solve_tone")
def solve_tone(spark, sf_dir):
    """Controls that bring each histogram to one look."""
    wanted = F.array(*[F.lit(v) for v in (0.02, 0.05, 0.08, 0.17, 0.34, 0.55, 0.74, 0.82, 0.95)])
    h = histograms(spark, sf_dir).withColumns({"prior": _neutral(), "wanted": wanted})
    return tone.solved(h).select("vec_id", "tone.*", "left")


@query("meet_constraints")
def meet_constraints(spark, sf_dir):
    """The least moves that keep shadows, highlights, contrast and two parts of the frame within bounds."""
    limit = lambda region, place, low, high: F.struct(F.lit(region).cast("string").alias("region"), F.lit(place).cast("int").alias("place"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))
    limits = F.array(limit(None, 1, 0.04, None), limit(None, 8, None, 0.97), limit(None, None, 0.2, 0.6), limit("sky", 7, None, 0.9), limit("subject", 4, 0.15, None))
    h = histograms(spark, sf_dir).withColumns({"prior": _neutral(), "limits": limits, "free": F.lit(None).cast("array<string>")})
    return tone.bounded(h).select("vec_id", "tone.*", "left")


#: Where intents begin, as display values.
THRESHOLDS = {"mid_low": 0.25, "mid_high": 0.45, "highlight_cap": 0.85, "shadow_floor": 0.06, "deep_shadow_cap": 0.04}


@query("apply_intents")
def apply_intents(spark, sf_dir):
    """Settings that meet three intents half of the way."""
    h = histograms(spark, sf_dir).withColumn("settings", F.create_map(F.lit("Exposure2012"), F.col("vec_id") % 5 / 10.0, F.lit("Vibrance"), F.lit(12.0)))
    out = tone.intended(h, "settings", ["Save-the-sky", "expose-correctly", "soft-contrast"], THRESHOLDS, strength=0.5)
    return out.select("vec_id", *[F.try_element_at("settings", F.lit(k)).alias(k) for k in ("Exposure2012", "Contrast2012", "Highlights2012", "Whites2012", "Shadows2012", "Vibrance")], "left")


@query("look_regression")
def look_regression(spark, sf_dir):
    """Looks foretold from features by held-out sessions, in order, against the mean look; and the controls for them."""
    h = histograms(spark, sf_dir).withColumn("tone", _tone())
    h = h.withColumn("look", look.look_of(F.col("stops"), F.col("weights"), F.col("anchor"), F.col("tone")))
    x = F.concat(look.look_of(F.col("stops"), F.col("weights"), F.col("anchor"), _neutral()), F.array("anchor", *[F.col("tone")[c] for c in ("exposure", "contrast")]))
    told = looks.foretold(h.select("vec_id", (F.col("vec_id") % 40).alias("session"), x.alias("x"), "look"), "vec_id", "session", "x", "look")
    return told.select("vec_id", "fold", F.transform("foretold", r6).alias("foretold"), r6(F.col("off")).alias("off"), r6(F.col("off_constant")).alias("off_constant"))
