"""BM25 pieces shared by the written index: corpus statistics and the two factors of a score.

Scoring [defined here; the reference delegates it to its server]:
  idf(t)   = ln(1 + (N - df + 0.5) / (df + 0.5))
  bm25     = sum_t idf(t) * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl))
  phrase   = (sum of the phrase's distinct term idfs) with tf = phrase occurrences
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex.config import SearchConfig


def corpus_stats(analyzed: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl); a global aggregate with map-side partials."""
    return analyzed.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").cast("double").alias("avgdl"))


def idf(df_col: Column, n_docs: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df_col + F.lit(0.5)) / (df_col + F.lit(0.5)))


def tf_norm(tf: Column, dl: Column, avgdl: Column, cfg: SearchConfig) -> Column:
    k1, b = F.lit(cfg.k1), F.lit(cfg.b)
    return tf * (k1 + 1) / (tf + k1 * (F.lit(1.0) - b + b * dl / avgdl))
