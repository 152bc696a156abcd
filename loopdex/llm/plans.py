"""The registered queries of this package, each an operator applied to its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.llm import (
    hard_negatives,
    kneser_ney,
    learned_partitions,
    mixing,
    ngram_join,
    prefix_trie,
    quality_rules,
    sentencepieces,
    separators,
    simhash,
    url_filter,
    warc,
    wavelet,
)
from loopdex.llm.common import read

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_OF_TEXT = 50256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(read(spark, sf_dir, "documents", "doc_id", "text"), drop=("text",))
    return rows.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captured(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(BYTE_BPE), special_as_text=False).drop("shard")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge(pages, url_filter.repeated(pages)).select("page_id", "host", "path", "rule", "listed", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixing.taken_by_document(mixing.schedule(sizes)).select("doc_id", "size", "source_size", "target", "taken")


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.counted(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(BYTE_BPE), END_OF_TEXT)


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), width=4, percent=85)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(PIECES), ids=False).select("doc_id", "n_tokens", "ids_crc32", "decodes", "n_differ")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kneser_ney.scores(read(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return hard_negatives.mine(rows.withColumn("label", hard_negatives.shifted_label(F.col("vec_id"), F.col("label"))))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), width=4, bits=4).select("doc_id", "fingerprint", "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_warc, op3_wavelet_shards, op4_url_filter, op5_mixing, op6_separator_scan, op7_learned_partitions, op8_ngram_join, op9_sentencepiece, op10_kneser_ney,
        op11_prefix_trie, op12_hard_negatives, op13_simhash,
    )
}
ORACLE = {
    "op1_quality_rules": quality_rules.sql(),
    "op2_warc": warc.sql(),
    "op4_url_filter": url_filter.sql(),
    "op5_mixing": mixing.sql(),
    "op11_prefix_trie": prefix_trie.sql(),
    "op12_hard_negatives": hard_negatives.sql(),
}
