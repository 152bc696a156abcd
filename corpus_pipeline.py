"""The corpus pipeline: quality rules, near-duplicate removal, mixing to target weights, SentencePiece encoding.

Each stage works on all rows that the one before kept, written as Parquet in between. All but the last return the
columns of documents; the mix is in the rows themselves (a document taken twice is two rows, one cut at the budget has
the words that were taken).

Edge cases, as in the operators: empty tables pass through; null texts fail the quality rules; null sources are a
source of their own; rows that repeat a doc_id are one document to the near-duplicate stage; rows with a null doc_id
pass that stage and the mix unchanged, once each, as nothing could name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.llm import mixing, ngram_join, quality_rules, sentencepieces
from loopdex.llm.common import read, scratch, words
from loopdex.llm.plans import PIECES, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision rules keep."""
    return quality_rules.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that weighted fair queueing takes, in part where the budget ends inside one."""
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id IS NOT NULL")
    copies = mixing.schedule(mixing.sized(named)).where("taken > 0")
    taken = copies.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("size").alias("z")).agg(F.collect_list("taken").alias("taken"))
    rows = named.join(taken, (named.doc_id == taken.id) & named.source.eqNullSafe(taken.s)).withColumn("taken", F.explode("taken"))
    cut = F.concat_ws(" ", F.slice(words(F.col("text")), F.lit(1), F.col("taken").cast("int")))
    part = F.col("taken") < F.col("z")
    rows = rows.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    rows = rows.withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row of the mix."""
    return sentencepieces.encoded(docs, tokenizer_path(PIECES))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Near-duplicate components and SentencePiece ids can't be expressed in SQL; tests/llm compare with brute force.
ORACLE_SQL = None
