"""Ingest and stores, bundles, intents, and the rank profile from duels to stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import ranking
from ..registry import query
from .base import r6, table


@query("triage_store", "SELECT sha256(regexp_replace(url, '/[^/]*$', ''))[1:8] AS store, count(*) AS n FROM pages WHERE page_id % 3 <> 0 GROUP BY 1")
def triage_store(spark, sf_dir):
    """Marks by the store that their folder's digest names."""
    folder = F.regexp_replace("url", "/[^/]*$", "")
    return table(spark, sf_dir, "pages").filter("page_id % 3 <> 0").groupBy(F.left(F.sha2(folder, 256), F.lit(8)).alias("store")).agg(F.count(F.lit(1)).alias("n"))


@query("embedding_bundle", "SELECT vec_id, len(embedding) AS width, floor(list_avg(list_transform(embedding[1:5], lambda x: x::DOUBLE)) * 1e6 + 0.501) / 1e6 AS seed FROM embeddings")
def embedding_bundle(spark, sf_dir):
    """What the duels start from: the vector's width and the plain mean of its aspects."""
    aspects = arrays.doubles(F.slice("embedding", 1, 5))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("width"), r6(arrays.total(aspects) / F.size(aspects)).alias("seed"))


@query("dataset_load", "SELECT event_id, (json_extract(props, '$.k'))::DOUBLE AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def dataset_load(spark, sf_dir):
    """Rows of a JSON dataset, by a fixed schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k double", {"mode": "FAILFAST"})["k"].alias("k")).filter("k IS NOT NULL")


@query("rank_profile")
def rank_profile(spark, sf_dir):
    """From duels to stars: strengths of the duelled, a linear head on their vectors, cut-offs, stars of all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("x"))
    rivals = e.select("vec_id", "x", F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("step"))
    other = e.select((F.col("vec_id")).alias("rival"), F.get("x", 0).alias("v"))
    met = rivals.join(other, F.col("vec_id") + F.col("step") == F.col("rival"))
    won = F.get("x", 0) >= F.col("v")
    duels = met.select(F.concat_ws("-", "vec_id", "rival").alias("duel"), F.when(won, F.col("vec_id")).otherwise(F.col("rival")).alias("winner"), F.when(won, F.col("rival")).otherwise(F.col("vec_id")).alias("loser"))
    p = ranking.rank_profile(e.select(F.col("vec_id").alias("id"), "x"), duels)
    return e.select("vec_id", r6(p.merit(F.col("x"))).alias("merit"), p.stars(F.col("x")).alias("stars"), F.lit(p.accuracy).cast("double").alias("held_out_accuracy"))
