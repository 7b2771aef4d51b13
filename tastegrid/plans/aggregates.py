"""Grouped statistics: sessions, spreads, feedback, style, thresholds, counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.jsmath import logistic, or_else
from ..operators import feedback, sessions
from ..registry import query
from .base import DUELS, FRAMES, OBSERVED, PARAMS, duels, frames, observed, params, r6, table


@query("session_mean", f"WITH {PARAMS} SELECT session, param, floor(avg(value) * 1e6 + 0.501) / 1e6 AS mean FROM params GROUP BY 1, 2")
def session_mean(spark, sf_dir):
    f = frames(spark, sf_dir).select("file", "session", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"))
    names = F.array(*map(F.lit, ("quantity", "price", "discount", "tax")))
    return sessions.means(f, "session", "x").select("session", F.posexplode("mean").alias("i", "m")).select("session", F.get(names, F.col("i")).alias("param"), r6(F.col("m")).alias("mean"))


@query("level_residual", f"WITH {PARAMS} SELECT file, param, floor(avg(value) OVER w * 1e6 + 0.501) / 1e6 AS level, floor((value - avg(value) OVER w) * 1e6 + 0.501) / 1e6 AS residual FROM params WINDOW w AS (PARTITION BY session, param)")
def level_residual(spark, sf_dir):
    return sessions.levels(params(spark, sf_dir), "session", "param", "value").select("file", "param", r6(F.col("level")).alias("level"), r6(F.col("residual")).alias("residual"))


@query("zscore", f"WITH {PARAMS}, s AS (SELECT param, avg(value) AS mean, greatest(1e-6, stddev_pop(value)) AS spread FROM params GROUP BY 1) SELECT file, param, floor((value - mean) / spread * 1e4 + 0.501) / 1e4 AS z FROM params JOIN s USING (param)")
def zscore(spark, sf_dir):
    z = sessions.standardised(params(spark, sf_dir), "param", "value")
    return z.select("file", "param", (F.floor(F.col("z") * 1e4 + 0.501) / 1e4).alias("z"))


@query("degenerate", f"WITH {PARAMS}, all_params AS (SELECT * FROM params UNION ALL SELECT file, session, 'flat', 3.0 FROM frames) SELECT param, stddev_pop(value) < 1e-9 AS degenerate FROM all_params GROUP BY 1")
def degenerate(spark, sf_dir):
    flat = frames(spark, sf_dir).select("file", "session", F.lit("flat").alias("param"), F.lit(3.0).alias("value"))
    return sessions.spreads(params(spark, sf_dir).unionByName(flat), "param", "value").select("param", "degenerate")


@query("param_spread", f"WITH {PARAMS} SELECT param, count(*) AS n, floor(stddev_pop(value) * 1e4 + 0.501) / 1e4 AS spread FROM params GROUP BY 1 HAVING count(*) >= 2 AND stddev_pop(value) > 1e-6")
def param_spread(spark, sf_dir):
    s = sessions.spreads(params(spark, sf_dir), "param", "value").filter(f"n >= 2 AND spread > {sessions.LEAST_SPREAD}")
    return s.select("param", "n", (F.floor(F.col("spread") * 1e4 + 0.501) / 1e4).alias("spread"))


@query("correction_weights", f"""WITH {OBSERVED}, s AS (SELECT param, stddev_pop(actual) AS spread FROM observed GROUP BY 1), z AS (SELECT file, avg(abs(actual - predicted) / spread) AS z FROM observed JOIN s USING (param) GROUP BY 1)
  SELECT file, floor(z * 1e4 + 0.501) / 1e4 AS z, floor(least(greatest(z / (SELECT median(z) FROM z), 0.25), 3.0) * 1e4 + 0.501) / 1e4 AS weight FROM z""")
def correction_weights(spark, sf_dir):
    o = observed(spark, sf_dir)
    spreads = sessions.spreads(o, "param", "actual").select("param", "spread")
    w = feedback.correction_weights(o, spreads)
    return w.select("file", *[(F.floor(F.col(c) * 1e4 + 0.501) / 1e4).alias(c) for c in ("z", "weight")])


@query("feedback_summary", f"""WITH {OBSERVED} SELECT param, count(*) AS compared, count(*) FILTER (abs(actual - predicted) <= 20000) AS kept, count(*) FILTER (abs(actual - neutral) > 20000 OR abs(predicted - neutral) > 20000) AS engaged,
  count(*) FILTER (abs(actual - predicted) <= 20000 AND (abs(actual - neutral) > 20000 OR abs(predicted - neutral) > 20000)) AS engaged_kept, floor(avg(actual - predicted) * 100 + 0.501) / 100 AS bias, floor((1 - sum(abs(actual - predicted)) / sum(abs(actual - neutral))) * 1e6 + 0.501) / 1e6 AS journey FROM observed GROUP BY 1""")
def feedback_summary(spark, sf_dir):
    s = feedback.summary(observed(spark, sf_dir), 20000.0)
    return s.withColumn("bias", F.floor(F.col("bias") * 100 + 0.501) / 100).withColumn("journey", r6(F.col("journey")))


@query("reliability_floor", "SELECT o_orderpriority AS param, greatest(3, least(20, ceil(count(*) / 400.0)))::BIGINT AS floor FROM orders GROUP BY 1")
def reliability_floor(spark, sf_dir):
    """How many comparisons a figure needs before it is shown: a share of all, between 3 and 20."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("param")).agg(F.greatest(F.lit(3), F.least(F.lit(20), F.ceil(n / 400.0))).cast("long").alias("floor"))


@query("calibration_offsets", f"""WITH {OBSERVED}, m AS (SELECT session, param, median(actual - predicted) AS m FROM observed GROUP BY 1, 2),
  a AS (SELECT param, count(*) AS n_sessions, count(*) FILTER (m > 0) AS up, count(*) FILTER (m < 0) AS down, median(m) AS middle FROM m GROUP BY 1), b AS (SELECT *, CASE WHEN up + down > 0 THEN abs(up - down) / sqrt(up + down) ELSE 0 END AS sigma FROM a)
  SELECT param, n_sessions, floor(sigma * 1e6 + 0.501) / 1e6 AS sigma, floor((CASE WHEN n_sessions >= 4 AND sigma >= 2 THEN middle * 0.5 ELSE 0 END) * 100 + 0.501) / 100 AS offset_value FROM b""")
def calibration_offsets(spark, sf_dir):
    return feedback.offsets(observed(spark, sf_dir)).select("param", "n_sessions", r6(F.col("sigma")).alias("sigma"), (F.floor(F.col("offset") * 100 + 0.501) / 100).alias("offset_value"))


@query("style_shrink", f"""WITH {PARAMS}, m AS (SELECT session, param, avg(value) AS m FROM params GROUP BY 1, 2), f AS (SELECT param, stddev_samp(value) AS fsd FROM params GROUP BY 1),
  a AS (SELECT param, count(*) AS n_sessions, avg(m) AS mean, stddev_samp(m) AS sd FROM m GROUP BY 1), b AS (SELECT *, (CASE WHEN n_sessions >= 3 THEN sd ELSE fsd END) / sqrt(n_sessions) AS se FROM a JOIN f USING (param))
  SELECT param, n_sessions, floor(mean * 1e4 + 0.501) / 1e4 AS mean, floor(greatest(0, 1 - se * se / (mean * mean)) * 1e6 + 0.501) / 1e6 AS shrink FROM b""")
def style_shrink(spark, sf_dir):
    s = feedback.style(params(spark, sf_dir))
    return s.select("param", "n_sessions", (F.floor(F.col("mean") * 1e4 + 0.501) / 1e4).alias("mean"), r6(F.col("shrink")).alias("shrink"))


@query("intent_thresholds", "SELECT r_name, floor(quantile_cont(c_acctbal, 0.5) * 1e4 + 0.501) / 1e4 AS p50, floor(quantile_cont(c_acctbal, 0.3) * 1e4 + 0.501) / 1e4 AS p30, floor(quantile_cont(c_acctbal, 0.7) * 1e4 + 0.501) / 1e4 AS p70 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) >= 20")
def intent_thresholds(spark, sf_dir):
    """Interpolated quantiles; groups with too few rows keep their defaults."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    q = c.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.percentile("c_acctbal", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.7))).alias("q")).filter("n >= 20")
    return q.select("r_name", *[(F.floor(F.get("q", i) * 1e4 + 0.501) / 1e4).alias(n) for i, n in enumerate(("p50", "p30", "p70"))])


@query("star_calibration", f"""WITH {PARAMS}, s AS (SELECT param, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM params GROUP BY 1),
  m AS (SELECT param, list_sort(list(1 / (1 + exp(-(value - mean) / sd)))) AS v FROM params JOIN s USING (param) GROUP BY 1)
  SELECT param, floor(v[floor(0.9 * (len(v) - 1) + 0.5)::INT + 1] * 1e4 + 0.501) / 1e4 AS s5, floor(v[floor(0.5 * (len(v) - 1) + 0.5)::INT + 1] * 1e4 + 0.501) / 1e4 AS s3, floor(v[floor(0.1 * (len(v) - 1) + 0.5)::INT + 1] * 1e4 + 0.501) / 1e4 AS s1 FROM m""")
def star_calibration(spark, sf_dir):
    """Cut-offs at nearest-rank percentiles of the logistic of the standardised score. The rank is taken from
    per-value counts, so no group is collected."""
    p = params(spark, sf_dir)
    s = p.groupBy("param").agg(F.avg("value").alias("mean"), or_else(F.stddev_pop("value"), 1.0).alias("sd"), F.count(F.lit(1)).alias("n"))
    counts = p.groupBy("param", "value").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("param").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).join(s, "param").withColumn("merit", logistic((F.col("value") - F.col("mean")) / F.col("sd")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q + 0.5), F.col("merit")))
    cut = lambda q, n: (F.floor(at(q) * 1e4 + 0.501) / 1e4).alias(n)
    return ranked.groupBy("param").agg(cut(0.9, "s5"), cut(0.5, "s3"), cut(0.1, "s1"))


@query("render_vocab", "SELECT p_type AS look, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3")
def render_vocab(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("look")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("library_totals", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS picks, count(*) FILTER (o_orderstatus = 'P') AS review, count(*) FILTER (o_totalprice < 1000) AS rejected, floor(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) * 100 + 0.501) / 100 AS mean FROM orders")
def library_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mean = F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return o.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("picks"), F.count_if(F.col("o_orderstatus") == "P").alias("review"), F.count_if(F.col("o_totalprice") < 1000).alias("rejected"), (F.floor(mean * 100 + 0.501) / 100).alias("mean"))


@query("param_states", f"WITH {PARAMS}, s AS (SELECT param, session, stddev_pop(value) AS s FROM params GROUP BY 1, 2), v AS (SELECT param, CASE WHEN s < 1e-9 THEN 'constant' WHEN s < 0.02 THEN 'leveled' ELSE 'predicted' END AS state FROM s) SELECT param, state, count(*) AS n FROM v GROUP BY 1, 2")
def param_states(spark, sf_dir):
    s = params(spark, sf_dir).groupBy("param", "session").agg(F.stddev_pop("value").alias("s"))
    state = F.when(F.col("s") < 1e-9, "constant").when(F.col("s") < 0.02, "leveled").otherwise("predicted")
    return s.groupBy("param", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("comparison_counts", f"WITH {DUELS}, p AS (SELECT DISTINCT event_type AS id FROM events) SELECT id, (SELECT count(*) FROM duels WHERE winner = id OR loser = id) AS n FROM p")
def comparison_counts(spark, sf_dir):
    """Duels of each photograph, on either side; a duel with itself counts once."""
    d = duels(spark, sf_dir)
    sides = d.select(F.explode(F.array_distinct(F.array("winner", "loser"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ids = table(spark, sf_dir, "events").select(F.col("event_type").alias("id")).distinct()
    return ids.join(sides, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("pair_counts", f"WITH {DUELS} SELECT winner, loser, count(*) AS n FROM duels GROUP BY 1, 2")
def pair_counts(spark, sf_dir):
    return duels(spark, sf_dir).groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_models", "SELECT DISTINCT p_brand, count(*) OVER () AS total FROM part")
def distinct_models(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_brand").distinct().crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("total"))))


@query("distinct_sessions", "SELECT event_type, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def distinct_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("sessions"))


@query("cluster_signature", "SELECT label, count(*) AS n, floor(avg(embedding[1]::DOUBLE) * 1e6 + 0.501) / 1e6 AS m1, floor(avg(embedding[2]::DOUBLE) * 1e6 + 0.501) / 1e6 AS m2 FROM embeddings GROUP BY 1")
def cluster_signature(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.get("embedding", i).cast("double"))).alias(f"m{i + 1}") for i in (0, 1)])


@query("frequent_keys", "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key FROM events UNION ALL SELECT event_id, event_type FROM events) SELECT key, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM events)")
def frequent_keys(spark, sf_dir):
    """Keys that a tenth of the rows have at least."""
    e = table(spark, sf_dir, "events")
    keys = e.select(F.explode(F.concat(F.json_object_keys("props"), F.array("event_type"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("_all")))).filter("n >= 0.1 * _all").drop("_all")


@query("cache_usage", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def cache_usage(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("cleanup_summary", "SELECT l_returnflag AS part, l_linestatus AS kind, count(*) AS n, sum(l_quantity) AS amount FROM lineitem GROUP BY ROLLUP (1, 2)")
def cleanup_summary(spark, sf_dir):
    """Counts and amounts by part and kind, with subtotals."""
    return table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("part"), F.col("l_linestatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("amount"))


@query("kappa", f"WITH {PARAMS}, s AS (SELECT param, session, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM params GROUP BY 1, 2) SELECT param, floor(avg(v) / var_pop(m) * 1e3 + 0.501) / 1e3 AS kappa FROM s WHERE n > 1 GROUP BY 1")
def kappa(spark, sf_dir):
    """Within- over between-session variance, by moments."""
    s = params(spark, sf_dir).groupBy("param", "session").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).filter("n > 1")
    return s.groupBy("param").agg((F.floor(F.avg("v") / F.var_pop("m") * 1e3 + 0.501) / 1e3).alias("kappa"))


@query("variance_shares", f"""WITH {PARAMS}, m AS (SELECT *, avg(value) OVER (PARTITION BY session, param) AS sm, avg(value) OVER (PARTITION BY param) AS gm FROM params)
  SELECT param, floor(avg(gm * gm) / avg(value * value) * 1e6 + 0.501) / 1e6 AS constant, floor(avg((sm - gm) * (sm - gm)) / avg(value * value) * 1e6 + 0.501) / 1e6 AS between_sessions, floor(avg((value - sm) * (value - sm)) / avg(value * value) * 1e6 + 0.501) / 1e6 AS within_sessions FROM m GROUP BY 1""")
def variance_shares(spark, sf_dir):
    """Shares of the mean square: of the constant, between sessions, within. From sums, without a window."""
    s = params(spark, sf_dir).groupBy("param", "session").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("sq"), F.var_pop("value").alias("v"))
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    square = F.sum(F.col("n") * F.col("sq")) / n
    within = F.sum(F.col("n") * F.col("v")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / n - mean * mean
    return s.groupBy("param").agg(r6(mean * mean / square).alias("constant"), r6(between / square).alias("between_sessions"), r6(within / square).alias("within_sessions"))


@query("sign_agreement", f"WITH {FRAMES}, s AS (SELECT session, corr(l_quantity, l_extendedprice) AS r FROM frames GROUP BY 1) SELECT count(*) FILTER (sign(r) = sign((SELECT corr(l_quantity, l_extendedprice) FROM frames))) AS agree, count(*) AS sessions FROM s")
def sign_agreement(spark, sf_dir):
    """Sessions whose own correlation has the sign of all together."""
    f = frames(spark, sf_dir)
    pooled = f.agg(F.corr("l_quantity", "l_extendedprice").alias("_all"))
    s = f.groupBy("session").agg(F.corr("l_quantity", "l_extendedprice").alias("r")).crossJoin(F.broadcast(pooled))
    return s.agg(F.count_if(F.signum("r") == F.signum("_all")).alias("agree"), F.count(F.lit(1)).alias("sessions"))


@query("within_sd", f"WITH {PARAMS}, s AS (SELECT param, session, stddev_pop(value) AS sd FROM params GROUP BY 1, 2 HAVING count(*) > 2) SELECT param, floor(avg(sd) * 1e4 + 0.501) / 1e4 AS sd FROM s GROUP BY 1")
def within_sd(spark, sf_dir):
    s = params(spark, sf_dir).groupBy("param", "session").agg(F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return s.groupBy("param").agg((F.floor(F.avg("sd") * 1e4 + 0.501) / 1e4).alias("sd"))


@query("triage_list", "SELECT o_orderpriority AS store, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'O') AS applied FROM orders GROUP BY 1")
def triage_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("store")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_if(F.col("o_orderstatus") != "O").alias("applied"))


@query("pearson", f"WITH {FRAMES} SELECT l_returnflag, floor(corr(l_quantity, l_discount) * 1e6 + 0.501) / 1e6 AS r FROM frames GROUP BY 1")
def pearson(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_discount")).alias("r"))


@query("session_slope", f"WITH {FRAMES} SELECT session, floor(regr_slope(l_extendedprice, l_quantity) * 1e3 + 0.501) / 1e3 AS slope FROM frames GROUP BY 1 HAVING count(*) > 2")
def session_slope(spark, sf_dir):
    s = frames(spark, sf_dir).groupBy("session").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("s"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return s.select("session", (F.floor(F.col("s") * 1e3 + 0.501) / 1e3).alias("slope"))


@query("log_ratio_mae", f"WITH {OBSERVED} SELECT param, floor(avg(abs(ln(actual / predicted))) * 1e6 + 0.501) / 1e6 AS mae FROM observed WHERE actual > 0 AND predicted > 0 GROUP BY 1")
def log_ratio_mae(spark, sf_dir):
    o = observed(spark, sf_dir).filter("actual > 0 AND predicted > 0")
    return o.groupBy("param").agg(r6(F.avg(F.abs(F.log(F.col("actual") / F.col("predicted"))))).alias("mae"))


@query("mae_skill", f"WITH {OBSERVED}, c AS (SELECT param, avg(actual) AS mean FROM observed GROUP BY 1) SELECT param, floor((1 - sum(abs(actual - predicted)) / sum(abs(actual - mean))) * 1e6 + 0.501) / 1e6 AS skill FROM observed JOIN c USING (param) GROUP BY 1")
def mae_skill(spark, sf_dir):
    """1 - MAE of the model over MAE of the constant."""
    o = observed(spark, sf_dir)
    means = o.groupBy("param").agg(F.avg("actual").alias("mean"))
    off = lambda c: F.sum(F.abs(F.col("actual") - F.col(c)))
    return sessions.beside(o, means, "param").groupBy("param").agg(r6(1 - off("predicted") / off("mean")).alias("skill"))


@query("weighted_skill", f"""WITH {OBSERVED}, c AS (SELECT param, avg(actual) AS mean FROM observed GROUP BY 1), s AS (SELECT param, 1 - sum(abs(actual - predicted)) / sum(abs(actual - mean)) AS skill, left(param, 1)::INT AS weight FROM observed JOIN c USING (param) GROUP BY 1)
  SELECT floor(sum(weight * skill) / sum(weight) * 1e6 + 0.501) / 1e6 AS skill FROM s WHERE weight >= 1.5""")
def weighted_skill(spark, sf_dir):
    """The headline: skill weighted over parameters that matter."""
    o = observed(spark, sf_dir)
    means = o.groupBy("param").agg(F.avg("actual").alias("mean"))
    off = lambda c: F.sum(F.abs(F.col("actual") - F.col(c)))
    s = sessions.beside(o, means, "param").groupBy("param").agg((1 - off("predicted") / off("mean")).alias("skill")).withColumn("weight", F.left("param", F.lit(1)).cast("int")).filter("weight >= 1.5")
    return s.agg(r6(F.sum(F.col("weight") * F.col("skill")) / F.sum("weight")).alias("skill"))


