"""Ordered analytics: newest wins, naming, eviction, sampling, folds, top rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays
from ..functions.text import rendered
from ..operators import folds, keyed, library, ordered, review, sessions
from ..registry import query
from .base import FRAMES, PARAMS, frames, params, r6, table


@query("journal_latest", """WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, bool_or(event_id % 7 = 0) OVER (PARTITION BY user_id, event_type) AS trained, min(event_id) OVER (PARTITION BY user_id, event_type) AS trained_at FROM events)
  SELECT user_id, event_type, event_id, value, trained, trained_at FROM w WHERE rn = 1""")
def journal_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("trained", F.col("event_id") % 7 == 0).withColumn("trained_at", F.col("event_id"))
    j = keyed.journal(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], "trained", "trained_at")
    return j.select("user_id", "event_type", "event_id", "value", "trained", "trained_at")


@query("cache_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def cache_latest(spark, sf_dir):
    """Last write wins in an append log."""
    return keyed.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query("naming_plan", """WITH o AS (SELECT o_orderkey, o_custkey % 40 AS cam, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate, o_orderkey) AS seq FROM orders), n AS (SELECT *, 'cam' || cam || '_' || lpad((seq // 2)::VARCHAR, 4, '0') AS stem FROM o)
  SELECT o_orderkey, stem || CASE WHEN row_number() OVER (PARTITION BY lower(stem) ORDER BY seq) > 1 THEN '_' || row_number() OVER (PARTITION BY lower(stem) ORDER BY seq) ELSE '' END || '.raw' AS name FROM n""")
def naming_plan(spark, sf_dir):
    """Numbered names in order of date; names that collide get _2, _3 and so on."""
    o = table(spark, sf_dir, "orders").withColumn("cam", F.col("o_custkey") % 40)
    seq = F.row_number().over(Window.partitionBy("cam").orderBy("o_orderdate", "o_orderkey"))
    named = o.withColumn("seq", seq).withColumn("stem", rendered("cam{camera}_{seq:4}", {"camera": F.col("cam"), "seq": F.floor(F.col("seq") / 2)}, {"camera": "nocamera"}))
    return library.unique_names(named, "stem", [F.col("seq")], ".raw").select("o_orderkey", F.col("stem").alias("name"))


@query("cache_evict", """WITH p AS (SELECT source, min(doc_id) AS used, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1), r AS (SELECT *, sum(bytes) OVER (ORDER BY used DESC) AS newer FROM p)
  SELECT source, bytes FROM r WHERE newer > (SELECT sum(n_chars) // 2 FROM documents) AND source <> 'src0'""")
def cache_evict(spark, sf_dir):
    """The oldest packs, until the rest fits; packs in use stay. One row per pack is what is ordered."""
    d = table(spark, sf_dir, "documents")
    packs = d.groupBy("source").agg(F.min("doc_id").alias("used"), F.sum("n_chars").alias("bytes"))
    budget = d.agg((F.sum("n_chars") / 2).cast("long").alias("budget"))
    newer = F.sum("bytes").over(Window.orderBy(F.col("used").desc()))
    return packs.withColumn("newer", newer).crossJoin(F.broadcast(budget)).filter("newer > budget AND source <> 'src0'").select("source", "bytes")


@query("hist_percentile", f"WITH {FRAMES}, h AS (SELECT session, l_quantity::INT AS bin, count(*) AS n FROM frames GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY session) AS total FROM h) SELECT session, min(bin) AS p95 FROM c WHERE cum >= 0.95 * total GROUP BY 1")
def hist_percentile(spark, sf_dir):
    """The first bin at which the cumulative histogram reaches a share."""
    h = frames(spark, sf_dir).groupBy("session", F.col("l_quantity").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session")
    c = h.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return c.filter("cum >= 0.95 * total").groupBy("session").agg(F.min("bin").alias("p95"))


@query("sample_by_shoot", """WITH s AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS j FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(j * 618034 % 1000000), c_custkey) AS round FROM s)
  SELECT c_nationkey, c_custkey, round FROM r ORDER BY round, c_nationkey LIMIT 40""")
def sample_by_shoot(spark, sf_dir):
    """A spread sample: each session gives one frame a round, spread by the golden ratio within the session."""
    by = Window.partitionBy("c_nationkey")
    s = table(spark, sf_dir, "customer").withColumn("j", F.row_number().over(by.orderBy("c_custkey")) - 1).withColumn("spread", F.col("j").cast("long") * 618034 % 1000000)
    return s.withColumn("round", F.row_number().over(by.orderBy("spread", "c_custkey"))).select("c_nationkey", "c_custkey", "round").orderBy("round", "c_nationkey").limit(40)


@query("curve_monotone", "SELECT vec_id, list_transform(range(1, 10), lambda i: list_max(list_transform(embedding[1:i], lambda x: x::DOUBLE))) AS curve FROM embeddings")
def curve_monotone(spark, sf_dir):
    """Knots raised to the greatest before them."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", arrays.running_max(arrays.doubles(F.slice("embedding", 1, 9))).alias("curve"))


@query("elo_pool", "WITH c AS (SELECT event_type AS id, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, user_id) AS rn, count(*) OVER (PARTITION BY id) AS total FROM c) SELECT id, user_id FROM r WHERE rn <= greatest(1, total // 4)")
def elo_pool(spark, sf_dir):
    """The quarter with the fewest duels, one at least."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id")
    r = c.withColumn("rn", F.row_number().over(w.orderBy("n", "user_id"))).withColumn("total", F.count(F.lit(1)).over(w))
    return r.filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("total") / 4))).select("id", "user_id")


@query("closest_elo", "SELECT a.s_suppkey AS id, (SELECT b.s_suppkey FROM supplier b WHERE b.s_suppkey <> a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey LIMIT 1) AS opponent FROM supplier a")
def closest_elo(spark, sf_dir):
    """The opponent with the nearest rating, of equally near ones the least: it has the same rating, or the next one
    below or above."""
    near = ordered.neighbours(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("s_acctbal") - F.col(c)["v"]).alias("d"), F.col(c)["id"].alias("id")))
    return near.select(F.col("s_suppkey").alias("id"), F.least(option("below"), option("level"), option("above"))["id"].alias("opponent"))


#: Distances in millionths that make a strip, as a power of two.
STRIP_BITS = 28


@query("tail_rows", f"WITH {PARAMS}, d AS (SELECT file, param, abs(value - avg(value) OVER (PARTITION BY param)) AS off FROM params), r AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY off) AS rn, count(*) OVER (PARTITION BY param) AS n FROM d), c AS (SELECT param, floor(off * 1e6) AS cut FROM r WHERE rn = least(floor(0.8 * n), n - 1) + 1) SELECT param, count(*) AS n FROM d JOIN c USING (param) WHERE floor(off * 1e6) >= cut GROUP BY 1")
def tail_rows(spark, sf_dir):
    """How many rows lie as far from the mean as the element at floor(.8 n) of the sorted distances, from counts per distance."""
    p = params(spark, sf_dir)
    means = p.groupBy("param").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    off = sessions.beside(p, means, "param").groupBy("param", "n", F.floor(F.abs(F.col("value") - F.col("mean")) * 1e6).alias("off")).agg(F.count(F.lit(1)).alias("k"))
    # a few hundred strips of distances tell in which the element lies; only that strip's distances are put in order
    target = F.least(F.floor(F.col("n") * 0.8), F.col("n") - 1)
    strip = F.shiftright("off", STRIP_BITS)
    by_strip = off.groupBy("param", "n", strip.alias("at")).agg(F.sum("k").alias("k"))
    running = lambda by: F.sum("k").over(Window.partitionBy("param").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    met = by_strip.withColumn("upto", running("at")).filter((F.col("upto") > target) & (F.col("upto") - F.col("k") <= target))
    held = sessions.beside(off, met.select("param", "at", (F.col("upto") - F.col("k")).alias("before"), (F.col("n") - F.col("upto")).alias("after")), "param").filter(strip == F.col("at"))
    cut = held.withColumn("upto", F.col("before") + running("off")).filter(F.col("upto") > target)
    return cut.groupBy("param").agg((F.sum("k") + F.max("after")).alias("n"))


@query("mode_pick", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1")
def mode_pick(spark, sf_dir):
    """The commonest value; of equals the one seen first."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("event_type"))


@query("library_sort", "SELECT p_partkey, row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 7 <> 0 THEN p_size % 6 END, -1) DESC, p_partkey) AS place FROM part")
def library_sort(spark, sf_dir):
    """By stars, unrated last, else as they stand."""
    stars = F.coalesce(F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 6), F.lit(-1))
    rated = table(spark, sf_dir, "part").select("p_partkey", stars.alias("stars"))
    return ordered.numbered(rated, [-F.col("stars"), F.col("p_partkey")]).select("p_partkey", "place")


@query("outbox_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 500")
def outbox_pending(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey").orderBy("o_orderkey").limit(500)


@query("focus_peak", "WITH e AS (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings) SELECT vec_id, floor(list_avg(s[1:greatest(1, floor(len(s) * 0.05 + 0.5))::INT]) * 1e6 + 0.501) / 1e6 AS peak FROM e")
def focus_peak(spark, sf_dir):
    """The mean of the sharpest twentieth of the tiles."""
    peak = arrays.top_mean(arrays.doubles(F.col("embedding")), 0.05)
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.floor(peak * 1e6 + 0.501) / 1e6).alias("peak"))


@query("fold_assign", f"""WITH RECURSIVE {FRAMES}, s AS (SELECT session, count(*) AS n FROM frames GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, session) AS k FROM s),
  d AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS w, NULL::BIGINT AS session, 0::BIGINT AS n, 0 AS fold
    UNION ALL SELECT o.k, list_transform(w, lambda x, i: x + CASE WHEN i = list_position(w, list_min(w)) THEN o.n ELSE 0 END), o.session, o.n, list_position(w, list_min(w)) - 1 FROM d JOIN o ON o.k = d.k + 1)
  SELECT session, n, fold FROM d WHERE k > 0""")
def fold_assign(spark, sf_dir):
    """Sessions dealt to folds, the largest first into the lightest."""
    return folds.balanced(frames(spark, sf_dir), "session", 5)


@query("fold_rows", f"WITH {FRAMES}, r AS (SELECT file, l_partkey, row_number() OVER (ORDER BY md5(file)) AS rn FROM frames) SELECT (rn - 1) % 5 AS fold, count(*) AS n FROM r GROUP BY 1")
def fold_rows(spark, sf_dir):
    """Single rows dealt to folds in a hashed order: fold sizes differ by one at most."""
    return folds.round_robin(frames(spark, sf_dir), "file", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


#: The families of the review screen and what their sliders are, by frame; the half-width of their dead zones in spreads.
REVIEWED = {"quantity": ("l_quantity", "l_extendedprice / 1000"), "price": ("l_extendedprice / 1000", "l_quantity"), "discount": ("l_discount", "l_extendedprice / 1000"), "tax": ("l_tax", "l_extendedprice / 1000")}
DEAD = 0.5


def _picks() -> str:
    """p1, p2, ...: the frames of the first family, of the first two, and so on; no file is taken twice."""
    best = lambda k, but: f"(SELECT k, param, file, excess FROM e WHERE k = {k} AND excess > 0{but} ORDER BY excess DESC, file LIMIT 1)"
    more = [f"p{k} AS (SELECT * FROM p{k - 1} UNION ALL {best(k, f' AND file NOT IN (SELECT file FROM p{k - 1})')})" for k in range(2, len(REVIEWED) + 1)]
    return ", ".join([f"p1 AS {best(1, '')}", *more])


# x: a row per frame and family; s, t, m: spreads, the sums of a fit, anchors; e: what is above a dead zone; c: distances from all centres
@query("review_frames", f"""WITH {FRAMES}, f AS (SELECT *, row_number() OVER () AS id FROM frames),
  x AS ({" UNION ALL ".join(f"SELECT {k} AS k, '{p}' AS param, id, file, {v} AS value, {y} AS slider FROM f WHERE isfinite({v})" for k, (p, (v, y)) in enumerate(REVIEWED.items(), 1))}),
  s AS (SELECT k, avg(value) AS mean, stddev_pop(value) AS sd FROM x WHERE isfinite(slider) GROUP BY k HAVING count(*) >= 60 AND stddev_pop(value) >= 1e-9 AND stddev_pop(slider) >= 1e-9),
  z AS (SELECT k, mean, sd, greatest((value - mean) / sd - {DEAD}, 0) AS up, least((value - mean) / sd + {DEAD}, 0) AS down, slider AS y FROM x JOIN s USING (k) WHERE isfinite(slider)),
  t AS (SELECT k, mean, sd, count(*) + 1e-9 AS n, sum(up) AS u, sum(down) AS d, sum(up * up) + 1e-9 AS uu, sum(down * down) + 1e-9 AS dd, sum(y) AS y, sum(up * y) AS uy, sum(down * y) AS dy FROM z GROUP BY ALL),
  g AS (SELECT *, (uy - u * (y - u * uy / uu - d * dy / dd) / (n - u * u / uu - d * d / dd)) / uu AS above FROM t),
  m AS (SELECT k, floor(mean * 1e6 + 0.501) / 1e6 AS centre, floor(above / sd * 1e6 + 0.501) / 1e6 AS gain, floor({DEAD} * sd * 1e6 + 0.501) / 1e6 AS dead FROM g),
  b AS (SELECT x.*, value - centre AS gap, gain, dead, CASE WHEN dead > 0 THEN dead ELSE 1 END AS zone FROM x JOIN m USING (k)),
  e AS (SELECT *, abs(gain * (gap - dead)) / greatest(1, abs(gain) * zone) AS excess FROM b WHERE gap - dead > 0), {_picks()},
  c AS (SELECT id, any_value(file) AS file, max(abs(gap) / zone) AS off FROM b GROUP BY id),
  a AS (SELECT * FROM p{len(REVIEWED)} UNION ALL (SELECT {len(REVIEWED) + 1}, NULL, file, off FROM c WHERE file NOT IN (SELECT file FROM p{len(REVIEWED)}) ORDER BY off, file LIMIT 1))
  SELECT row_number() OVER (ORDER BY k) AS place, param, file, floor(excess * 1e6 + 0.501) / 1e6 AS excess FROM a""")
def review_frames(spark, sf_dir):
    """For each family, one after the other, the frame with the largest correction above its dead zone that none has
    taken; last the control, which is nearest all centres. Anchors have a fixed width here: anchor_fit chooses widths."""
    values, sliders = (F.array(*[F.expr(of[i]) for of in REVIEWED.values()]) for i in (0, 1))
    f = frames(spark, sf_dir).select("file", values.alias("values"), sliders.alias("sliders"))
    found = review.picked(f, "file", "values", review.anchored(f, list(REVIEWED), "values", "sliders", DEAD))
    out = spark.createDataFrame([(i, *pick) for i, pick in enumerate(found, 1)], "place long, param string, file string, excess double")
    return out.withColumn("excess", r6(F.col("excess")))
