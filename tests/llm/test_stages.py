"""Each stage of the pipeline by itself on odd rows: nulls in every column, empty and repeated texts, names that clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
BODY = " ".join(f"w{k}" for k in range(40))
ROWS = [(1, BODY, "en", "a", 9), (1, BODY, "en", "a", 9), (2, BODY + " end", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (None, BODY + " other words of a row without an id", "en", "b", 1), (5, None, None, None, None), (6, "é " * 3000, "fr", "b", 1)]
CLASH = ("kept", "score", "predicted", "shard", "taken", "target", "_bucket", "component_id", "n_words")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_on_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("own") for c in CLASH})
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != "bpe":
        assert out.columns == docs.columns and all(r["kept"] == r["_bucket"] == "own" for r in rows)
        assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS}
    else:
        assert len(rows) == len(ROWS) and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    if name == "jaccard_join":
        # of equal and nearly equal texts one row with the least id stays, and so do rows without an id or without words
        assert sorted(str(r["doc_id"]) for r in rows if r["text"] and r["text"].startswith("w0")) == ["1", "None"]
        assert {3, 4, 5} <= {r["doc_id"] for r in rows}
    assert stage(spark, docs.limit(0), SF).count() == 0
