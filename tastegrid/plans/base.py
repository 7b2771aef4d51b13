"""Table access, and the library's entities taken from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all tasks: a table of few bytes is read by one task or two, however long its rows are worked on."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from lineitem: file, session, and four features."""
    li = table(spark, sf_dir, "lineitem")
    file = F.concat_ws("/", F.lit("/cat"), F.col("l_suppkey"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return li.select(file.alias("file"), F.col("l_suppkey").alias("session"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_partkey", "l_orderkey", "l_linenumber")


FRAMES = """frames AS (SELECT '/cat/' || l_suppkey || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS file, l_suppkey AS session,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_partkey, l_orderkey, l_linenumber FROM lineitem)"""


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames' features in long form: file, session, param, value."""
    f = frames(spark, sf_dir)
    return f.select("file", "session", F.expr("stack(4, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount, 'tax', l_tax) AS (param, value)"))


PARAMS = f"""{FRAMES}, params AS (
  SELECT file, session, 'quantity' AS param, l_quantity AS value FROM frames UNION ALL SELECT file, session, 'price', l_extendedprice FROM frames
  UNION ALL SELECT file, session, 'discount', l_discount FROM frames UNION ALL SELECT file, session, 'tax', l_tax FROM frames)"""


def duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duels from each user's consecutive events: the larger value wins. id, winner, loser are event types."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.lead("event_type").over(w).alias("next_type"), F.lead("value").over(w).alias("next_value"))
    won = F.col("value") >= F.col("next_value")
    return e.filter("next_type IS NOT NULL AND next_type <> event_type").select("event_id", "user_id", F.when(won, F.col("event_type")).otherwise(F.col("next_type")).alias("winner"), F.when(won, F.col("next_type")).otherwise(F.col("event_type")).alias("loser"))


DUELS = """turns AS (SELECT event_id, user_id, event_type, value, lead(event_type) OVER w AS next_type, lead(value) OVER w AS next_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  duels AS (SELECT event_id, user_id, CASE WHEN value >= next_value THEN event_type ELSE next_type END AS winner,
    CASE WHEN value >= next_value THEN next_type ELSE event_type END AS loser FROM turns WHERE next_type IS NOT NULL AND next_type <> event_type)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and kept values: an order's total against the sum of its lines; session is the customer."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kept = li.groupBy("l_orderkey").agg(F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) * 10000 + 0.5).alias("_cents")).select("l_orderkey", (F.col("_cents") / 10000.0).alias("actual"))
    return o.join(kept, o["o_orderkey"] == kept["l_orderkey"]).select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("param"), F.col("o_totalprice").alias("predicted"), "actual", F.lit(0.0).alias("neutral"))


OBSERVED = """kept AS (SELECT l_orderkey, floor(sum(l_extendedprice * (1 - l_discount)) * 10000 + 0.5) / 10000.0 AS actual FROM lineitem GROUP BY 1),
  observed AS (SELECT o_orderkey AS file, o_custkey AS session, o_orderpriority AS param, o_totalprice AS predicted, actual, 0.0::DOUBLE AS neutral
    FROM orders JOIN kept ON o_orderkey = l_orderkey)"""


def r6(x):
    """A double at six decimals, halves up, as floor in both engines. Means of decimals often lie on a half: a thousandth
    of the last place below it counts as the half, so that the last bits of a sum, and with them the order of rows, do
    not decide."""
    return F.floor(x * 1e6 + 0.501) / 1e6
