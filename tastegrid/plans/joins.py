"""Keyed lookups as joins, and the cross products over small dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import keyed, keywords, library, sessions
from ..registry import query
from .base import DUELS, FRAMES, OBSERVED, PARAMS, duels, frames, observed, params, r6, table


@query("library_merge", """WITH l AS (SELECT l_orderkey, count(*) AS n_lines, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
  SELECT o_orderkey, o_orderstatus, coalesce(n_lines, 0) AS n_lines, top, c_mktsegment, coalesce(n_name, '?') AS nation FROM orders
  LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def library_merge(spark, sf_dir):
    """Photographs with what is known of each: four left joins by key."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_linenumber").alias("top"))
    out = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("o_orderkey", "o_orderstatus", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "top", "c_mktsegment", F.coalesce("n_name", F.lit("?")).alias("nation"))


@query("valid_results", """WITH r AS (SELECT p_partkey AS k, p_size + p_partkey % 2 AS size, p_brand AS verdict FROM part)
  SELECT p_partkey, verdict FROM part LEFT JOIN r ON p_partkey = k AND p_size = size""")
def valid_results(spark, sf_dir):
    """Stored results that still fit the file: key and identity must match."""
    part = table(spark, sf_dir, "part")
    r = part.select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 2).alias("p_size"), F.col("p_brand").alias("verdict"))
    return library.valid_results(part, r, "p_partkey", ["p_size"], ["verdict"]).select("p_partkey", "verdict")


@query("duel_pairs", f"""WITH {DUELS}, photos AS (SELECT event_type AS id, avg(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1)
  SELECT event_id, winner, loser FROM duels JOIN photos a ON winner = a.id JOIN photos b ON loser = b.id""")
def duel_pairs(spark, sf_dir):
    """Duels between known photographs."""
    known = table(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.col("event_type").alias("id")).distinct()
    d = duels(spark, sf_dir)
    return d.join(known.withColumnRenamed("id", "winner"), "winner").join(known.withColumnRenamed("id", "loser"), "loser").select("event_id", "winner", "loser")


@query("duelled", f"WITH {DUELS} SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT user_id FROM duels WHERE winner = 'purchase' OR loser = 'purchase')")
def duelled(spark, sf_dir):
    """Those that took part in a duel."""
    d = duels(spark, sf_dir).filter("winner = 'purchase' OR loser = 'purchase'").select("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().join(d, "user_id", "left_semi")


@query("unmatched", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("observations", f"WITH {OBSERVED} SELECT file, session, param, predicted, actual FROM observed")
def observations(spark, sf_dir):
    return observed(spark, sf_dir).select("file", "session", "param", "predicted", "actual")


@query("session_context", f"""WITH {FRAMES}, m AS (SELECT session, avg(l_quantity) AS a, avg(l_discount) AS b FROM frames GROUP BY 1)
  SELECT file, floor(a * 1e6 + 0.501) / 1e6 AS a, floor(b * 1e6 + 0.501) / 1e6 AS b FROM frames JOIN m USING (session)""")
def session_context(spark, sf_dir):
    f = frames(spark, sf_dir).select("file", "session", F.array("l_quantity", "l_discount").alias("x"))
    c = sessions.with_context(f, "session", "x")
    return c.select("file", r6(F.get("context", 0)).alias("a"), r6(F.get("context", 1)).alias("b"))


@query("deviation", f"""WITH {FRAMES}, m AS (SELECT session, avg(l_quantity) AS a, avg(l_discount) AS b FROM frames GROUP BY 1)
  SELECT file, floor((l_quantity - a) * 1e6 + 0.501) / 1e6 AS a, floor((l_discount - b) * 1e6 + 0.501) / 1e6 AS b FROM frames JOIN m USING (session)""")
def deviation(spark, sf_dir):
    f = frames(spark, sf_dir).select("file", "session", F.array("l_quantity", "l_discount").alias("x"))
    c = sessions.with_context(f, "session", "x").withColumn("d", arrays.deviation(F.col("x"), F.col("context")))
    return c.select("file", r6(F.get("d", 0)).alias("a"), r6(F.get("d", 1)).alias("b"))


@query("fold_shoot", """WITH n AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 0.0 FROM customer WHERE c_custkey % 10 = 0)
  SELECT c_custkey, c_acctbal FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def fold_shoot(spark, sf_dir):
    """New rows over old ones by key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return keyed.folded(c, new, "c_custkey")


@query("keyword_topk", """WITH v AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS s FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT vec_id, v.label, list_sum(list_transform(list_zip(e.embedding, v.c), lambda z: z[1]::DOUBLE * z[2])) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(v.c, lambda x: x * x))) AS score FROM embeddings e, v),
  k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY floor(score * 1e6 + 0.5) DESC, label) AS rank FROM s)
  SELECT vec_id, rank, label, floor(score * 1e6 + 0.5) / 1e6 AS score FROM k WHERE rank <= 6 AND floor(score * 1e6 + 0.5) / 1e6 >= 0.05""")
def keyword_topk(spark, sf_dir):
    """The six best terms of a small vocabulary, of which those at the floor or above count: limit, then filter."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("x"))
    cells = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    vocabulary = cells.groupBy(F.col("label").alias("term")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("vector"))
    unit = lambda c: arrays.l2_normal(F.col(c)).alias(c)
    return keywords.top(e.select("vec_id", unit("x")), vocabulary.select("term", unit("vector")), "vec_id", "x", floor=0.05)


@query("worn_objects", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity AS x0, l_quantity + 10 AS x1 FROM lineitem)
  SELECT DISTINCT o.l_orderkey, o.l_linenumber, o.l_partkey FROM b o JOIN b p ON o.l_orderkey = p.l_orderkey AND o.l_returnflag = 'R' AND p.l_returnflag = 'A' WHERE greatest(0, least(o.x1, p.x1) - greatest(o.x0, p.x0)) / (o.x1 - o.x0) > 0.6""")
def worn_objects(spark, sf_dir):
    """Objects of a frame that lie mostly within a person of the same frame."""
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"))
    persons = b.filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.collect_list(F.struct("x0", "x1")).alias("persons"))
    share = lambda p: F.greatest(F.lit(0.0), F.least(F.col("x1"), p["x1"]) - F.greatest(F.col("x0"), p["x0"])) / (F.col("x1") - F.col("x0"))
    return b.filter("l_returnflag = 'R'").join(persons, "l_orderkey").filter(F.exists("persons", lambda p: share(p) > 0.6)).select("l_orderkey", "l_linenumber", "l_partkey").distinct()


@query("dense_targets", """WITH d AS (SELECT unnest(['k', 'tint', 'grain']) AS param, unnest([0.0, 5.0, 50.0]) AS neutral)
  SELECT event_id, param, coalesce(json_extract(props, '$.' || param)::DOUBLE, neutral) AS value FROM events, d""")
def dense_targets(spark, sf_dir):
    """Every parameter of every frame; one that is absent is at its neutral value."""
    d = spark.createDataFrame([("k", 0.0), ("tint", 5.0), ("grain", 50.0)], "param string, neutral double")
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,double>").alias("m"))
    return e.crossJoin(F.broadcast(d)).select("event_id", "param", F.coalesce(F.try_element_at("m", F.col("param")), F.col("neutral")).alias("value"))


@query("marks_wanted", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def marks_wanted(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("migrations", """WITH m AS (SELECT unnest([3, 12, 30]) AS version, unnest(['Brand#1', 'Brand#2', 'Brand#3']) AS affects)
  SELECT p_partkey, version FROM part JOIN m ON starts_with(p_brand, affects) AND p_size < version AND version <= 40""")
def migrations(spark, sf_dir):
    """Stored stamps against the migrations that touch them: on kind and on a range of versions."""
    m = spark.createDataFrame([(3, "Brand#1"), (12, "Brand#2"), (30, "Brand#3")], "version int, affects string")
    return table(spark, sf_dir, "part").join(F.broadcast(m), F.col("p_brand").startswith(F.col("affects")) & (F.col("p_size") < F.col("version")) & (F.col("version") <= 40)).select("p_partkey", "version")


@query("pending_sessions", """WITH p AS (SELECT user_id, max(event_id) AS predicted FROM events WHERE event_type = 'view' GROUP BY 1), l AS (SELECT user_id, max(event_id) AS learned FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT p.user_id, predicted FROM p LEFT JOIN l USING (user_id) WHERE learned IS NULL OR predicted > learned""")
def pending_sessions(spark, sf_dir):
    """Sessions never learned from, or predicted again since."""
    e = table(spark, sf_dir, "events")
    p = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("predicted"))
    learned = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("learned"))
    return p.join(learned, "user_id", "left").filter("learned IS NULL OR predicted > learned").select("user_id", "predicted")


@query("refine_due", f"""WITH {FRAMES}, now AS (SELECT session, count(*) AS n, sum(l_orderkey) AS print FROM frames GROUP BY 1), was AS (SELECT s_suppkey AS session, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE (SELECT print FROM now WHERE now.session = s_suppkey) END AS print FROM supplier WHERE s_suppkey % 3 <> 0)
  SELECT s_suppkey AS session, CASE WHEN s_suppkey % 7 = 0 THEN 'incomplete' WHEN now.session IS NULL THEN 'gone' WHEN n < 3 THEN 'empty' WHEN was.print IS NOT NULL AND was.print = now.print THEN 'unchanged' ELSE 'due' END AS verdict
  FROM supplier LEFT JOIN now ON s_suppkey = now.session LEFT JOIN was ON s_suppkey = was.session""")
def refine_due(spark, sf_dir):
    """Why each session is passed over, or that it is due: the first reason that applies."""
    now = frames(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("print"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session"))
    was = supplier.filter("session % 3 <> 0").join(now, "session", "left").select("session", F.when(F.col("session") % 4 == 0, 0).otherwise(F.col("print")).alias("was_print"))
    j = supplier.join(now, "session", "left").join(was, "session", "left")
    reason = library.refine_verdict(complete=F.col("session") % 7 != 0, there=F.col("n").isNotNull(), n=F.col("n"), least=3, print_now=F.col("print"), print_then=F.col("was_print"))
    return j.select("session", reason.alias("verdict"))


@query("apply_errors", "SELECT p_partkey, 'no prediction' AS error FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)")
def apply_errors(spark, sf_dir):
    predicted = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(predicted, "p_partkey", "left_anti").select("p_partkey", F.lit("no prediction").alias("error"))


@query("catalog_index", "SELECT a.page_id, b.page_id AS found FROM pages a LEFT JOIN (SELECT lower(url) AS k, min(page_id) AS page_id FROM pages GROUP BY 1) b ON lower(upper(a.url)) = b.k")
def catalog_index(spark, sf_dir):
    """Lookup by a case-folded path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    index = pages.groupBy(F.lower("url").alias("k")).agg(F.min("page_id").alias("found"))
    return pages.join(index, F.lower(F.upper("url")) == F.col("k"), "left").select("page_id", "found")


@query("path_list", """WITH wanted AS (SELECT DISTINCT trim(line) AS path FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#'))
  SELECT path, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.text = path) THEN 'found' ELSE 'missing' END AS status FROM wanted""")
def path_list(spark, sf_dir):
    """An explicit list: blank lines and comments dropped, duplicates once, missing entries reported."""
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("line"))
    wanted = lines.select(F.trim("line").alias("path")).filter((F.col("path") != "") & ~F.col("path").startswith("#")).distinct()
    known = table(spark, sf_dir, "documents").select(F.col("text").alias("path"), F.lit("found").alias("status")).distinct()
    return wanted.join(known, "path", "left").select("path", F.coalesce("status", F.lit("missing")).alias("status"))


@query("params_long", f"WITH {PARAMS} SELECT file, param, value FROM params WHERE param IN ('discount', 'tax')")
def params_long(spark, sf_dir):
    """Shared and branch parameters together, as long rows."""
    return params(spark, sf_dir).filter(F.col("param").isin("discount", "tax")).select("file", "param", "value")
