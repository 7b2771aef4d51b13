"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, hamming_search, html_text, jaccard_join, kd_clusters, language_id, licenses, mixing, quality_classifier, quality_rules, sharding, warc
from .common import table, written

TOKENIZER = "word_bpe_49k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "sizes")
    named = lambda field: F.array_join(F.transform("copies", lambda c: c[field].cast("string")), ",")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"), named("block").alias("blocks"), named("shard").alias("shards"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.coded(docs, public_tokenizers.path(TOKENIZER))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = written(hamming_search.binary_codes(table(spark, sf_dir, "embeddings")), "binary")
    return hamming_search.search(codes, codes.filter(F.col("id") % 20 == 0))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.clustered(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.languages(docs).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_hamming_search": op7_hamming_search,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scans": op9_license_scans,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_language_id": op13_language_id,
}
