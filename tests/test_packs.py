"""Logs of packs: last-wins before and after compaction, writers that die, readers that stay; functions that fail."""

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructType

from tastegrid.operators import isolated
from tastegrid.sources import packs
from tastegrid.streaming import online

SCHEMA = StructType().add("file", "string").add("size", "long").add("value", "double")


def _log(spark, path):
    return packs.Log(spark, f"file://{path}/log", ["file"], SCHEMA)


def _state(df):
    return {r["file"]: (r["size"], r["value"]) for r in df.collect()}


def test_last_wins_before_and_after_compaction(spark, tmp_path):
    log = _log(spark, tmp_path)
    assert log.read().count() == 0 and log.compact() == 0
    put = lambda rows, **o: log.append(spark.createDataFrame(rows, SCHEMA), **o)
    put([("a", 1, 0.1), ("b", 1, 0.2), ("c", 1, None)])
    put([("a", 2, 0.3), ("d", 1, 0.4)])
    put([("b", 0, None)], deletes=True)
    old = log.read()
    want = {"a": (2, 0.3), "c": (1, None), "d": (1, 0.4)}
    assert _state(old) == want
    assert log.compact() == 4 and len(log.packs()) == 1 and _state(log.read()) == want
    assert _state(old) == want and _state(log.read(3)) == want
    put([("b", 9, 0.9)])
    assert _state(log.read()) == want | {"b": (9, 0.9)} and log.vacuum(keep=2) == 3 and _state(log.read()) == want | {"b": (9, 0.9)}
    files = spark.createDataFrame([("a", 2), ("b", 8), ("c", 1)], "file string, size long")
    assert sorted(_state(packs.hits(log.read(), files, "file", ["size"]))) == ["a", "c"]


def test_a_writer_that_dies_leaves_the_log_readable(spark, tmp_path, monkeypatch):
    log = _log(spark, tmp_path)
    log.append(spark.createDataFrame([("a", 1, 0.1)], SCHEMA))
    monkeypatch.setattr(packs.Store, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        log.append(spark.createDataFrame([("a", 2, 0.2)], SCHEMA))
    with pytest.raises(KeyboardInterrupt):
        log._changed(lambda packs: packs)
    monkeypatch.undo()
    assert _state(log.read()) == {"a": (1, 0.1)} and log.vacuum() == 1 and _state(log.read()) == {"a": (1, 0.1)}


def test_commits_that_are_overtaken_are_made_again(spark, tmp_path):
    """Someone appends while another compacts, and two append at once: nothing is lost."""
    log, other = _log(spark, tmp_path), _log(spark, tmp_path)
    row = lambda f: spark.createDataFrame([(f, 1, 1.0)], SCHEMA)
    log.append(row("a"))
    log.append(row("b"))
    real = packs.Store.commit

    def late(store, name, text):
        if store is log.store and not late.done:
            late.done = True
            other.append(row("c"))
        return real(store, name, text)

    late.done = False
    try:
        packs.Store.commit = late
        log.compact()
        late.done = False
        log.append(row("d"))
    finally:
        packs.Store.commit = real
    assert sorted(_state(log.read())) == ["a", "b", "c", "d"]
    with pytest.raises(packs.Conflict):
        packs.Store.commit = lambda *a: False
        try:
            log.append(row("e"))
        finally:
            packs.Store.commit = real


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    log = _log(spark, tmp_path)
    spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("b", 1, 0.2)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    online.append_batches(stream(), log, ["size"], f"{tmp_path}/c1").awaitTermination()
    spark.createDataFrame([("c", 1, 0.5)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    online.append_batches(stream(), log, ["size"], f"{tmp_path}/c1").awaitTermination()
    want = {"a": (3, 0.3), "b": (1, 0.2), "c": (1, 0.5)}
    assert _state(log.read()) == want and len(log.packs()) == 2
    log.compact()
    version = log.append(spark.createDataFrame([("z", 1, 1.0)], SCHEMA), batch="log-0")
    assert version == 3 and _state(log.read()) == want


def _function(batch):
    values = batch.column(1).to_pylist()
    if any(v is None for v in values):
        raise TypeError("no number")
    return pa.RecordBatch.from_pydict({"inverse": pa.array([100 // v for v in values], pa.int64())})


def test_failing_rows_are_told_and_the_rest_go_through(spark):
    rows = [(i, None if i == 77 else i % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v long").coalesce(1)
    got = isolated.mapped(df, _function, StructType([*StructType().add("inverse", LongType()).fields])).collect()
    assert [r["i"] for r in got] == list(range(500))
    for r in got:
        if r["v"] is None:
            assert r["error"] == "TypeError: no number" and r["inverse"] is None
        elif not r["v"]:
            assert r["error"].startswith("ZeroDivisionError") and r["inverse"] is None
        else:
            assert r["error"] is None and r["inverse"] == 100 // r["v"]


def test_runs_are_bounded_and_retries_help():
    calls = []

    class Once:
        failed = set()

        def __call__(self, batch):
            calls.append(batch.num_rows)
            first = batch.column(0)[0].as_py()
            if batch.num_rows == 1 and first == 5 and first not in self.failed:
                self.failed.add(first)
                raise OSError("for once")
            if 9 in batch.column(0).to_pylist():
                raise ValueError("poison")
            return batch

    class Frame:
        schema = StructType().add("i", LongType())

        def mapInArrow(self, run, schema):  # noqa: N802
            self.out = list(run([pa.RecordBatch.from_pydict({"i": list(range(1024))})]))
            return self.out

    double = lambda f: lambda b: pa.RecordBatch.from_arrays([f(b).column(0)], names=["j"])
    out = isolated.mapped(Frame(), double(Once()), StructType().add("j", LongType()), batch_rows=1024)
    assert sum(b.num_rows for b in out) == 1024 and [b.column(2)[0].as_py() for b in out if b.column(2)[0].as_py()] == ["ValueError: poison"]
    assert len(calls) <= 2 * 10 + 3 + isolated.ATTEMPTS
    with pytest.raises(ValueError, match="already"):
        isolated.mapped(Frame(), Once(), StructType().add("I", LongType()))
    short = isolated.mapped(Frame(), lambda b: b.slice(1), StructType().add("j", LongType()), batch_rows=4)
    assert all("rows for" in b.column(2)[0].as_py() for b in short)
