"""The library's commands as transforms of a table, for plans of steps, and queries that run such plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language
from ..operators import feedback, keyed, library, ordered
from ..registry import query
from . import steps
from .base import FRAMES, OBSERVED, frames, observed, r6, table

#: The cut-offs that a rating starts from: least merit and stars.
CUTS = ((0.9, 5), (0.7, 4), (0.5, 3), (0.3, 2), (0.1, 1))


def cull(df: DataFrame, score: str, peak: str, threshold: float = 100.0, rescue: float = 250.0, keep: bool = False) -> DataFrame:
    """df with verdict; keep: without the soft frames."""
    out = df.withColumn("verdict", library.verdict(F.col(score), F.col(peak), float(threshold), float(rescue)))
    return out.filter("verdict <> 'soft'") if keep else out


def rate(df: DataFrame, merit: str, focus: str, reject: float = 0.3, soft: float = 0.55, soft_cap: int = 1) -> DataFrame:
    """df with stars."""
    return df.withColumn("stars", library.stars(F.col(merit), F.col(focus), CUTS, float(reject), float(soft), int(soft_cap)))


def sort(df: DataFrame, by: str, key: str) -> DataFrame:
    """df with place: by falls, null comes last, then by key."""
    return ordered.numbered(df, [F.col(by).isNull(), -F.col(by), F.col(key)])


def rename(df: DataFrame, name: str, order: str, extension: str = "") -> DataFrame:
    """df with name made unique, in order."""
    return library.unique_names(df, name, [F.col(order)], extension)


def journal(df: DataFrame, key: str, newest: str) -> DataFrame:
    """The newest row of each key."""
    return keyed.latest(df, [key], [F.col(newest).desc()])


def told(df: DataFrame, tolerance: float = feedback.TOLERANCE) -> DataFrame:
    """Predicted against kept values by parameter, the worst journey first: place 1 on."""
    return ordered.numbered(feedback.summary(df, float(tolerance)), [F.col("journey"), F.col("param")])


def asked(df: DataFrame, text: str, lexicon: language.Lexicon = language.PRINTS) -> DataFrame:
    """df with intents, what its text asks for, and whether two of them contradict each other."""
    out = df.withColumn("intents", language.requested(F.col(text), lexicon)["intents"])
    return out.withColumn("contradicted", language.contradicted(F.col("intents"), lexicon))


TRANSFORMS: dict[str, steps.Transform] = {"cull": cull, "rate": rate, "sort": sort, "rename": rename, "journal": journal, "feedback": told, "intents": asked}

#: A plan over frames: cull, rate, order.
PLAN = {
    "version": 2,
    "vars": {"sharp": 100, "bar": "${sharp}"},
    "defaults": {"rate": {"merit": "merit", "focus": "focus"}},
    "steps": [
        {"id": "cull", "run": "cull", "with": {"score": "score", "peak": "peak", "threshold": "${bar}", "keep": True}},
        {"id": "rate", "run": "rate", "with": {"soft": 20, "reject": 5, "soft_cap": 3}},
        {"id": "again", "run": "rate", "enabled": False},
        {"id": "sort", "run": "sort", "with": {"by": "stars", "key": "file"}},
    ],
}


@query("steps_plan", f"""WITH {FRAMES}, m AS (SELECT file, l_quantity * 4 AS score, l_extendedprice / 100 AS peak, l_quantity / 50 AS merit, l_extendedprice / 1000 AS focus FROM frames),
  v AS (SELECT *, CASE WHEN score >= 100 THEN 'sharp' WHEN peak >= 250 THEN 'rescued' ELSE 'soft' END AS verdict, CASE WHEN merit >= 0.9 THEN 5 WHEN merit >= 0.7 THEN 4 WHEN merit >= 0.5 THEN 3 WHEN merit >= 0.3 THEN 2 WHEN merit >= 0.1 THEN 1 ELSE 0 END AS by_merit FROM m),
  s AS (SELECT file, verdict, CASE WHEN focus < 5 THEN 0 WHEN focus < 20 THEN least(by_merit, 3) ELSE by_merit END AS stars FROM v WHERE verdict <> 'soft') SELECT *, row_number() OVER (ORDER BY stars DESC, file) AS place FROM s""")
def steps_plan(spark, sf_dir):
    """A plan of steps: the soft frames go, the rest is rated and numbered, best first."""
    f = frames(spark, sf_dir).select("file", (F.col("l_quantity") * 4).alias("score"), (F.col("l_extendedprice") / 100).alias("peak"), (F.col("l_quantity") / 50).alias("merit"), (F.col("l_extendedprice") / 1000).alias("focus"))
    out, _ = steps.run(f, steps.resolved(PLAN, TRANSFORMS), TRANSFORMS)
    return out.select("file", "verdict", "stars", "place")


@query("feedback_worst", f"""WITH {OBSERVED}, s AS (SELECT param, count(*) AS compared, 1 - sum(abs(actual - predicted)) / sum(abs(actual - neutral)) AS journey FROM observed GROUP BY 1)
  SELECT row_number() OVER (ORDER BY journey, param) AS place, param, compared, floor(journey * 1e6 + 0.501) / 1e6 AS journey FROM s""")
def feedback_worst(spark, sf_dir):
    """Parameters by how far predictions fall short of what was kept, the worst first."""
    return told(observed(spark, sf_dir), 20000.0).select("place", "param", "compared", r6(F.col("journey")).alias("journey"))


@query("pending_newest", """WITH p AS (SELECT user_id, max(event_id) AS predicted FROM events WHERE event_type = 'view' GROUP BY 1), l AS (SELECT user_id, max(event_id) AS learned FROM events WHERE event_type = 'purchase' GROUP BY 1),
  d AS (SELECT p.user_id, predicted FROM p LEFT JOIN l USING (user_id) WHERE learned IS NULL OR predicted > learned) SELECT user_id, row_number() OVER (ORDER BY predicted DESC, user_id) AS place FROM d""")
def pending_newest(spark, sf_dir):
    """Sessions that wait to be learned from, the newest first."""
    e = table(spark, sf_dir, "events")
    p = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("predicted"))
    learned = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("learned"))
    due = p.join(learned, "user_id", "left").filter("learned IS NULL OR predicted > learned")
    return sort(due, "predicted", "user_id").select("user_id", "place")


@query("import_names", """WITH d AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9]+', '-', 'g'), ''), 'index') AS stem FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY page_id) AS nth FROM d)
  SELECT page_id, stem || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END || '.html' AS name FROM n""")
def import_names(spark, sf_dir):
    """File names for pages by the last part of their address, unique."""
    last = F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), "[^A-Za-z0-9]+", "-")
    stem = F.when(last == "", "index").otherwise(last)
    out = rename(table(spark, sf_dir, "pages").select("page_id", stem.alias("stem")), "stem", "page_id", ".html")
    return out.select("page_id", F.col("stem").alias("name"))
