"""A training corpus from raw documents: rules, classifier, near duplicates, source mix, tokens.

Cases: a null text counts as empty, which the rules reject; by itself, the classifier's stage gives it the mean score of its
labels, the join's leaves it alone, the mix takes none of it, and it has no tokens. A null source is a source; a row
without an id is a document like others, but links with none. Repeated rows are documents of their own up to the join, of
which one stays. Extra columns pass through all stages but the last, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import bpe, jaccard_join, mixing, quality_classifier, quality_rules
from tastegrid.llm.common import table, written


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines above their host's limit go from the others."""
    return quality_rules.cleaned(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold go."""
    return quality_classifier.quality_scores(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*docs.columns)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id."""
    return jaccard_join.deduplicated(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, by output shard and shuffled there; copies are whole documents."""
    return mixing.shuffled(mixing.mix(mixing.sized(docs), cut="whole")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with a digest of what they decode to."""
    coded = bpe.coded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("jaccard_join", jaccard_join_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The classifier and the tokenizer have no SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
