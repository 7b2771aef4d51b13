"""Plans over named tables: order, mistakes, going on after a stop; the commands of the chain."""

import pytest
from pyspark.sql import functions as F

from tastegrid.plans import chain, graph
from tastegrid.plans.steps import BadPlan


def _commands(log):
    def add(df, n=1, fail=False):
        log.append(n)
        if fail:
            raise RuntimeError("stopped")
        return df.withColumn("v", F.col("v") + n)

    def both(a, b):
        log.append("both")
        return a.unionByName(b)

    return {"add": add, "both": both}


def test_plans_go_on_where_they_stopped(spark, tmp_path):
    log = []
    commands = _commands(log)
    tables = {"t": spark.createDataFrame([(1,), (2,)], "v long")}
    plan = [{"id": "sum", "run": "both", "reads": {"a": "x", "b": "y"}}, {"id": "x", "run": "add", "reads": {"df": "t"}, "with": {"n": 10}}, {"id": "y", "run": "add", "reads": {"df": "x"}, "with": {"n": 5, "fail": True}}]
    folder = f"file://{tmp_path}"
    with pytest.raises(RuntimeError):
        graph.run(spark, plan, commands, tables, folder)
    plan[2]["with"] = {"n": 5}
    done = graph.run(spark, plan, commands, tables, folder)
    assert done.told == {"x": "there", "y": "ran", "sum": "ran"} and log == [10, 5, 5, "both"]
    assert sorted(r["v"] for r in done.results["sum"].collect()) == [11, 12, 16, 17]
    assert set(graph.run(spark, plan, commands, tables, folder).told.values()) == {"there"}
    plan[2]["with"] = {"n": 6}
    assert graph.run(spark, plan, commands, tables, folder).told == {"x": "there", "y": "ran", "sum": "ran"}
    assert set(graph.run(spark, plan, commands, tables, folder, {"t": "2"}).told.values()) == {"ran"}


def test_all_mistakes_are_told():
    plan = [{"id": "a", "run": "add", "reads": {"df": "nowhere"}}, {"id": "a", "run": "add"}, {"id": "b", "run": "fly", "more": 1}, {"id": "t", "run": "add"}]
    with pytest.raises(BadPlan) as told:
        graph.ordered(plan, _commands([]), {"t"})
    assert all(x in str(told.value) for x in ("nowhere", "twice", "fly", "more"))
    circle = [{"id": "a", "run": "add", "reads": {"df": "b"}}, {"id": "b", "run": "add", "reads": {"df": "a"}}]
    with pytest.raises(BadPlan, match="wait for each other"):
        graph.ordered(circle, _commands([]), set())


def test_commands_of_the_chain(spark):
    edits = spark.createDataFrame([("f1", 1, "p", 5.0, 0.0), ("f1", 1, "q", 0.0, 0.0), ("f2", 2, "p", 0.1, 0.0)], "file string, session int, param string, actual double, neutral double")
    rows = chain.init(edits)
    assert sorted((r["file"], r["param"], r["delta"]) for r in rows.collect()) == [("f1", "p", 5.0), ("f1", "q", 0.0)]
    predictions = spark.createDataFrame([("f1", 1, "p", 4.0), ("f3", 1, "p", 1.0)], "file string, session int, param string, predicted double")
    seen = chain.observe(predictions, edits)
    assert [(r["file"], r["predicted"], r["actual"], r["session"]) for r in seen.collect()] == [("f1", 4.0, 5.0, 1)]
    before = seen.withColumn("at", F.lit(1)).withColumn("actual", F.lit(9.0))
    newest = chain.journal(seen.withColumn("at", F.lit(2)), before).collect()
    assert [(r["at"], r["actual"]) for r in newest] == [(2, 5.0)]
    more = chain.init(edits.unionByName(edits.withColumn("file", F.lit("f9")).withColumn("actual", F.lit(7.0))))
    learned = {(r["file"], r["param"]): r["weight"] for r in chain.learn(more, seen).collect()}
    assert learned[("f9", "p")] == 1.0 and learned[("f1", "p")] == 1.0 and ("f1", "q") not in learned
    moved = chain.edit(predictions, spark.createDataFrame([("p", 2.0)], "param string, offset double"), 0.5).collect()
    assert sorted(r["predicted"] for r in moved) == [2.0, 5.0]
    assert [(r["place"], r["param"], r["compared"]) for r in chain.report(predictions, edits).collect()] == [(1, "p", 1)]
