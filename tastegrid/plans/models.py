"""Fitted models and scores: ranks, moments, profiles, anchors, tone, streams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from ..functions import arrays
from ..functions.jsmath import logistic
from ..operators import anchors, develop, evaluate, isolated, keyed, mixture, moments, ranking, structure
from ..registry import query
from ..sources import jsonl, packs
from ..sources.shared import shared_dir
from .base import DUELS, FRAMES, duels, frames, r6, table


def _regression(spark, sf_dir):
    """Frames with features x, targets y and a session."""
    f = frames(spark, sf_dir)
    x = F.array("l_quantity", F.col("l_tax") * 100, F.col("l_partkey") % 17 * F.lit(1.0))
    y = F.array(F.col("l_extendedprice") / 1000, F.col("l_discount") * 100)
    return f.select("file", "session", x.alias("x"), y.alias("y"), "l_returnflag")


@query("gram_matrix", f"WITH {FRAMES} SELECT l_returnflag, count(*) AS n, floor(sum(l_quantity * l_quantity) * 100 + 0.5) / 100 AS xx, floor(sum(l_quantity * l_tax * 100) * 100 + 0.5) / 100 AS xz, floor(sum(l_tax * l_tax * 10000) * 100 + 0.5) / 100 AS zz FROM frames GROUP BY 1")
def gram_matrix(spark, sf_dir):
    """Sums of products by group, from the moments that every fit uses."""
    parts = moments.collect(_regression(spark, sf_dir), "x", "y", "l_returnflag")
    rows = []
    for key, m in sorted(parts.items()):
        mean = m.mean[:2]
        raw = m.covariance[:2, :2] + m.weight * np.outer(mean, mean)
        rows.append((key, m.n, *[float(np.floor(v * 100 + 0.5) / 100) for v in (raw[0, 0], raw[0, 1], raw[1, 1])]))
    return spark.createDataFrame(rows, "l_returnflag string, n long, xx double, xz double, zz double")


@query("weighted_gram", f"WITH {FRAMES} SELECT l_returnflag, floor(sum(l_quantity * l_quantity * l_quantity) * 10 + 0.501) / 10 AS wxx, floor(sum(l_quantity * l_quantity * l_tax * 100) * 10 + 0.501) / 10 AS wxz FROM frames GROUP BY 1")
def weighted_gram(spark, sf_dir):
    """Weighted sums of products, from the moments that weighted fits use."""
    parts = moments.collect(_regression(spark, sf_dir).withColumn("w", F.get("x", 0)), "x", "y", "l_returnflag", "w")
    rows = []
    for key, m in sorted(parts.items()):
        mean = m.mean[:2]
        raw = m.covariance[:2, :2] + m.weight * np.outer(mean, mean)
        rows.append((key, *[float(np.floor(v * 10 + 0.501) / 10) for v in (raw[0, 0], raw[0, 1])]))
    return spark.createDataFrame(rows, "l_returnflag string, wxx double, wxz double")


# a line through centred points: slope = cov / (var + penalty), all sums by group
@query("ridge_line", f"""WITH {FRAMES}, s AS (SELECT l_returnflag, count(*) AS n, covar_pop(l_quantity, l_extendedprice / 1000) AS xy, var_pop(l_quantity) AS xx, avg(l_quantity) AS x, avg(l_extendedprice / 1000) AS y FROM frames GROUP BY 1),
  f AS (SELECT *, xy / (xx * 1.1) AS b FROM s) SELECT l_returnflag, n, floor(b * 1e6 + 0.501) / 1e6 AS slope, floor((y - b * x) * 1e6 + 0.501) / 1e6 AS intercept FROM f""")
def ridge_line(spark, sf_dir):
    """Ridge on one standardised column: the penalty is a tenth of its spread."""
    df = _regression(spark, sf_dir).select("l_returnflag", F.slice("x", 1, 1).alias("x"), F.slice("y", 1, 1).alias("y"))
    rows = []
    for key, m in sorted(moments.collect(df, "x", "y", "l_returnflag").items()):
        b, c = moments.ridge(m, 0.1, per_weight=True, standardised=True)
        rows.append((key, m.n, *[float(np.floor(v * 1e6 + 0.501) / 1e6) for v in (b[0, 0], c[0])]))
    return spark.createDataFrame(rows, "l_returnflag string, n long, slope double, intercept double")


@query("anchor_ls", f"WITH {FRAMES}, c AS (SELECT l_returnflag, l_quantity - 25 AS x, l_discount * 100 AS y FROM frames) SELECT l_returnflag, count(*) AS n, sum(greatest(x, 0)) AS up, sum(least(x, 0)) AS down, sum(greatest(x, 0) * greatest(x, 0)) AS up2, floor(sum(greatest(x, 0) * y) + 0.5) AS upy FROM c GROUP BY 1")
def anchor_ls(spark, sf_dir):
    """The sums behind an anchored slider without a dead zone."""
    rows = frames(spark, sf_dir).select("l_returnflag", (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100).alias("y"))
    out = anchors.sums(rows.withColumn("fold", F.lit(0)), ["l_returnflag"], widths=(0.0,))
    return out.select("l_returnflag", "n", "up", "down", "up2", F.floor(F.col("upy") + 0.5).cast("double").alias("upy"))


LEAGUES = f"""{DUELS}, l AS (SELECT user_id % 4 AS league, event_id, winner, loser FROM duels),
  ids AS (SELECT league, list_sort(list_distinct(list(id))) AS ids FROM (SELECT league, winner AS id FROM l UNION ALL SELECT league, loser FROM l) GROUP BY 1)"""
THETA = f"""WITH RECURSIVE {LEAGUES}, pair AS (SELECT league, winner, loser, count(*) AS n FROM l GROUP BY 1, 2, 3),
  cell AS (SELECT ids.league, i, j, coalesce(n, 0)::DOUBLE AS n FROM ids, range(1, len(ids) + 1) a(i), range(1, len(ids) + 1) b(j) LEFT JOIN pair ON pair.league = ids.league AND winner = ids[i] AND loser = ids[j]),
  row_ AS (SELECT league, i, list(n ORDER BY j) AS won FROM cell GROUP BY 1, 2), m AS (SELECT league, list(won ORDER BY i) AS w FROM row_ GROUP BY 1),
  met AS (SELECT league, i, sum(n) AS n FROM (SELECT league, i, n FROM cell UNION ALL SELECT league, j, n FROM cell) GROUP BY 1, 2), d AS (SELECT league, list(n ORDER BY i) AS d FROM met GROUP BY 1),
  step AS (SELECT league, 0 AS k, list_transform(d, lambda x: 0.0::DOUBLE) AS t FROM d UNION ALL
    SELECT league, k + 1, list_transform(list_transform(t, lambda x: x - list_avg(t)), lambda x, i: x + (list_sum(list_transform(t, lambda y, j: w[i][j] / (1 + exp(t[i] - y)) - w[j][i] / (1 + exp(y - t[i])))) - 0.01 * x) / (d[i] / 2 + 0.01)) FROM step JOIN m USING (league) JOIN d USING (league) WHERE k < 300)
  SELECT league, ids[i] AS id, floor((t[i] - list_avg(t)) * 1e6 + 0.501) / 1e6 AS strength, d[i]::BIGINT AS duels FROM step JOIN ids USING (league) JOIN d USING (league), range(1, 1 + len(t)) r(i) WHERE k = 300"""


def _elo_sql(start: str) -> str:
    """Ratings after the duels in order, a duel of every league a step; start: what each id begins with."""
    return f"""{LEAGUES}, turn AS (SELECT league, row_number() OVER (PARTITION BY league ORDER BY event_id) AS k, list_position(ids, winner) AS w, list_position(ids, loser) AS o FROM l JOIN ids USING (league)),
  begun AS (SELECT league, list({start} ORDER BY i) AS r FROM (SELECT league, ids[i] AS id, i FROM ids, range(1, len(ids) + 1) a(i)) GROUP BY 1),
  play AS (SELECT league, 0::BIGINT AS k, r FROM begun UNION ALL SELECT p.league, t.k, list_transform(r, lambda x, i: x + CASE WHEN i = w THEN 1 WHEN i = o THEN -1 ELSE 0 END * 32 * (1 - 1 / (1 + pow(10, (r[o] - r[w]) / 400.0)))) FROM play p JOIN turn t ON t.league = p.league AND t.k = p.k + 1),
  rated AS (SELECT league, ids[i] AS id, r[i] AS rating, (SELECT count(*) FROM turn t WHERE t.league = f.league AND (w = i OR o = i)) AS n FROM (SELECT league, arg_max(r, k) AS r FROM play GROUP BY 1) f JOIN ids USING (league), range(1, 1 + len(ids)) q(i))"""


def _leagues(spark, sf_dir):
    return duels(spark, sf_dir).withColumn("league", F.col("user_id") % 4)


@query("bt_theta", THETA)
def bt_theta(spark, sf_dir):
    """Bradley-Terry strengths of event types, by user group."""
    return ranking.bradley_terry(_leagues(spark, sf_dir), "league").withColumn("strength", r6(F.col("strength")))


@query("elo_ratings", f"WITH RECURSIVE {_elo_sql('1500.0::DOUBLE')} SELECT league, id, floor(rating * 1e6 + 0.501) / 1e6 AS rating, n FROM rated")
def elo_ratings(spark, sf_dir):
    return ranking.elo(_leagues(spark, sf_dir), "league", "event_id").withColumn("rating", r6(F.col("rating")))


@query("elo_seeded", f"WITH RECURSIVE {_elo_sql('1500 + (len(id) / 10.0 - 0.5) * 400')} SELECT league, id, floor(rating * 1e6 + 0.501) / 1e6 AS rating, n FROM rated")
def elo_seeded(spark, sf_dir):
    """Ratings that start from a score from 0 to 1."""
    d = _leagues(spark, sf_dir)
    seeds = d.select("league", F.explode(F.array("winner", "loser")).alias("id")).distinct().withColumn("score", F.length("id") / 10.0)
    return ranking.elo(d, "league", "event_id", seeds).withColumn("rating", r6(F.col("rating")))


@query("next_pair", f"""WITH RECURSIVE {_elo_sql('1500.0::DOUBLE')}, p AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY n, id) AS place, count(*) OVER (PARTITION BY league) AS of_ FROM rated),
  a AS (SELECT league, arg_min(id, (md5(league || ':' || id || ':0'), id)) AS a, arg_min(rating, (md5(league || ':' || id || ':0'), id)) AS r FROM p WHERE place <= greatest(1, of_ // 4) GROUP BY 1)
  SELECT league, a, arg_min(id, (abs(rating - r), id)) AS b FROM rated JOIN a USING (league) WHERE id <> a GROUP BY 1, 2""")
def next_pair(spark, sf_dir):
    return ranking.next_pair(ranking.elo(_leagues(spark, sf_dir), "league", "event_id"), "league")


@query("win_rates", f"WITH {DUELS}, s AS (SELECT winner AS id, 1 AS won FROM duels UNION ALL SELECT loser, 0 FROM duels) SELECT id, count(*) AS n, floor(avg(won) * 1e6 + 0.501) / 1e6 AS rate FROM s GROUP BY 1")
def win_rates(spark, sf_dir):
    sides = duels(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("winner").alias("id"), F.lit(1).alias("won")), F.struct(F.col("loser").alias("id"), F.lit(0).alias("won")))).alias("s")).select("s.*")
    return sides.groupBy("id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("won")).alias("rate"))


@query("rank_scores", """WITH s AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i % 5) - 2))) AS score FROM embeddings),
  m AS (SELECT vec_id, label, 1 / (1 + exp(-(score - (SELECT avg(score) FROM s)) / (SELECT stddev_pop(score) FROM s))) AS merit FROM s)
  SELECT label, CASE WHEN merit >= 0.8 THEN 5 WHEN merit >= 0.65 THEN 4 WHEN merit >= 0.5 THEN 3 WHEN merit >= 0.35 THEN 2 ELSE 1 END AS stars, count(*) AS n FROM m GROUP BY 1, 2""")
def rank_scores(spark, sf_dir):
    """A linear head over embeddings, standardised and cut into stars, by label."""
    weights = F.array(*[F.lit(float(i % 5 - 2)) for i in range(1, 65)])
    s = table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.dot(arrays.doubles(F.col("embedding")), weights).alias("score"))
    norm = s.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    merit = logistic((F.col("score") - F.col("mean")) / F.col("sd"))
    stars = F.when(F.col("merit") >= 0.8, 5).when(F.col("merit") >= 0.65, 4).when(F.col("merit") >= 0.5, 3).when(F.col("merit") >= 0.35, 2).otherwise(1)
    return s.crossJoin(F.broadcast(norm)).withColumn("merit", merit).groupBy("label", stars.alias("stars")).agg(F.count(F.lit(1)).alias("n"))


def _fixed_profile() -> develop.Profile:
    """A profile with plain figures: two parameters, two features and a rendering; the second's frame head is gated."""
    one = np.ones(2)
    head = lambda w, c, constant, gated: develop.Head(np.array(w), np.array(c), np.array(constant), np.array([1.5, 1.0]), np.array(gated), one, one, one, one)
    level = head([[0.513731, 0.0], [0.0, 2.017913], [3.0, 0.0], [-1.0, 0.25]], [1.000137, 0.500171], [10.0, 0.0], [False, False])
    frame = head([[0.251739, 0.0], [0.0, 1.0]], [0.0, 0.0], [0.0, 0.0], [False, True])
    return develop.Profile(["exposure", "tint"], level, frame, ["A", "R"], "A", offsets={"exposure": 0.75}, bounds={"exposure": (0.0, 30.0)}, guards={"schema": develop.SCHEMA, "dim": 2})


# a, b are the session's means; the level head stretches by 1.5 about 10, so does the frame head about 0
@query("predict_linear", f"""WITH {FRAMES}, m AS (SELECT file, l_quantity AS q, l_tax AS x, l_returnflag AS f, avg(l_quantity) OVER w AS a, avg(l_tax) OVER w AS b FROM frames WINDOW w AS (PARTITION BY session))
  SELECT file, floor(least(greatest(CASE WHEN q = 50 THEN 12.5 ELSE 10 + 1.5 * (0.513731 * a + CASE WHEN f = 'R' THEN -1 ELSE 3 END + 1.000137 - 10) + 1.5 * 0.251739 * (q - a) END + 0.75, 0), 30) * 1e4 + 0.5) / 1e4 AS exposure,
    floor((2.017913 * b + CASE WHEN f = 'R' THEN 0.25 ELSE 0 END + 0.500171) * 1e4 + 0.5) / 1e4 AS tint FROM m""")
def predict_linear(spark, sf_dir):
    """The predictor with a fixed profile: levels, deviations, a gate, an unknown rendering, an anchor, an offset, bounds."""
    f = frames(spark, sf_dir).select("file", "session", F.array("l_quantity", "l_tax").alias("x"), "l_returnflag", "l_quantity")
    anchor = {"exposure": F.when(F.col("l_quantity") == 50, 12.5)}
    out = develop.predicted(f, _fixed_profile(), "session", "x", facts={"schema": develop.SCHEMA, "dim": 2}, render="l_returnflag", anchors=anchor)
    return out.select("file", "exposure", "tint")


@query("cv_skill")
def cv_skill(spark, sf_dir):
    """Held-out skill by penalty and target, whole sessions held out."""
    return evaluate.skills(evaluate.with_folds(_regression(spark, sf_dir), "session", 5), "x", "y")


@query("develop_profile")
def develop_profile(spark, sf_dir):
    """A level head and a frame head: what held-out sessions do not support is a constant."""
    profile = develop.train(_regression(spark, sf_dir), "session", "x", "y", ["price", "discount"], render="l_returnflag")
    return spark.createDataFrame(profile.rows(), develop.ROWS)


@query("pca_explained")
def pca_explained(spark, sf_dir):
    """Leading axes of the embeddings and their shares."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("g"), arrays.doubles(F.col("embedding")).alias("x"), F.array(F.lit(0.0)).alias("y"))
    axes, share = moments.principal(moments.total(moments.collect(e, "x", "y", "g")), 16)
    return spark.createDataFrame([(i, float(s), axes[:, i].tolist()) for i, s in enumerate(share)], "axis int, share double, direction array<double>")


def _scatter(embeddings) -> float:
    """The sum of squares about the mean, which one cluster leaves."""
    cells = embeddings.select(F.posexplode(arrays.doubles(F.col("embedding"))).alias("i", "v"))
    return float(cells.groupBy("i").agg((F.var_pop("v") * F.count("v")).alias("s")).agg(F.sum("s")).first()[0] or 0.0)


@query("kmeans_inertia")
def kmeans_inertia(spark, sf_dir):
    """Cluster structure: the share of the scatter that k clusters explain."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select(array_to_vector(arrays.doubles(F.col("embedding"))).alias("features")).cache()
    rows = [(1, _scatter(table(spark, sf_dir, "embeddings")))] + [(k, float(KMeans(k=k, seed=7, maxIter=20).fit(e).summary.trainingCost)) for k in (2, 3, 4)]
    e.unpersist()
    return spark.createDataFrame([(k, cost, 1 - cost / rows[0][1]) for k, cost in rows], "k int, inertia double, explained double")


@query("cluster_null")
def cluster_null(spark, sf_dir):
    """What 2 to 4 clusters explain of the embeddings, and of five tables whose columns are shuffled each by itself."""
    found = structure.structure(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rounds=20)
    return spark.createDataFrame([(k, e, float(np.mean(nulls)), nulls) for k, e, nulls in found], "k int, explained double, null double, nulls array<double>")


@query("anchor_fit")
def anchor_fit(spark, sf_dir):
    f = frames(spark, sf_dir)
    samples = f.select(F.col("l_returnflag").alias("param"), F.lit("quantity").alias("feature"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("session").cast("string").alias("session"))
    return anchors.fits(samples)


@query("diagnose")
def diagnose(spark, sf_dir):
    """Skill of one model over all rows and of a model for each of 2 to 4 clusters of edits; the clusters' sizes."""
    found = mixture.diagnosed(_regression(spark, sf_dir), "session", "x", "y", "y", [2.0, 1.5])
    sizes = {c: [n for of, _, n, _, _ in found.clusters if of == c] for c, _ in found.skills}
    return spark.createDataFrame([(c, s, sizes[c]) for c, s in found.skills], "clusters int, skill double, sizes array<long>")


@query("skill_by_treatment")
def skill_by_treatment(spark, sf_dir):
    """Skill of one model over all rows against one a treatment."""
    d = evaluate.with_folds(_regression(spark, sf_dir), "session", 5)
    return evaluate.by_group(d, "x", "y", "l_returnflag")


@query("held_out_deltas")
def held_out_deltas(spark, sf_dir):
    """Every frame's edit as foretold by sessions other than its own."""
    d = evaluate.with_folds(_regression(spark, sf_dir), "session", 5)
    told = evaluate.held_out_deltas(d, "file", "x", "y", [0.1, 10.0], responses=[1.0, 0.5])
    return told.select("file", "fold", *[r6(F.get(c, i)).alias(f"{c}_{name}") for c in ("predicted", "truth") for i, name in enumerate(("price", "discount"))])


@query("scan_listing")
def scan_listing(spark, sf_dir):
    """The files of the data folder, by kind."""
    return jsonl.listing(spark, sf_dir).select("name", "ext", "size")


def _hundred_over(batch: pa.RecordBatch) -> pa.RecordBatch:
    """100 over the last digit of a size, which fails on 0."""
    return pa.RecordBatch.from_pydict({"value": pa.array([100 // (size % 10) for size in batch.column(1).to_pylist()], pa.int64())})


@query("safe_map", "SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN 100 // (p_size % 10) END AS value, CASE WHEN p_size % 10 = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error FROM part")
def safe_map(spark, sf_dir):
    """A function that fails on some rows: they give an error, not a failed job."""
    found = isolated.mapped(table(spark, sf_dir, "part").select("p_partkey", "p_size"), _hundred_over, StructType().add("value", LongType()))
    return found.drop("p_size")


CACHED = StructType().add("user_id", "long").add("event_type", "string").add("event_id", "long").add("value", "double")


@query("cache_compacted", "SELECT user_id, event_type, event_id, value FROM (SELECT * FROM events WHERE event_id % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 4 DESC, event_id DESC) = 1) WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 97 = 0)")
def cache_compacted(spark, sf_dir):
    """A log that is appended in four packs, compacted after two and again at the end, with keys that are deleted last."""
    e = table(spark, sf_dir, "events").select(*CACHED.fieldNames())
    log = packs.Log(spark, f"{shared_dir(spark)}/packs-{uuid.uuid4().hex}", ["user_id", "event_type"], CACHED)
    for k in range(4):
        log.append(keyed.latest(e.filter((F.col("event_id") % 5 != 4) & (F.col("event_id") % 4 == k)), log.key, [F.col("event_id").desc()]))
        if k == 1:
            log.compact()
    log.append(e.filter("event_id % 97 = 0").dropDuplicates(log.key), deletes=True)
    log.compact()
    return log.read()
