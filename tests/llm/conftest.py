import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of rows (doc_id, text) or (doc_id, text, source); with extra columns whose names clash with outputs."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if not extra:
            return df
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("own") for c in ("shard", "kept", "score", "matches", "ids", "extra")})

    return make
