"""Search plans over the fixture corpus (v_docs + embeddings) and the documents corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex import config as C
from loopdex.config import SearchConfig
from loopdex.operators.embedder import HashEmbedder
from loopdex.operators.search import Search, search
from loopdex.operators.search_store import SearchStore, read_store, write_store
from loopdex.operators.util import round6
from loopdex.plans.common import built
from loopdex.plans.oracle_search import search_ctes
from loopdex.sources import fixtures as fx

Q: dict = {}
O: dict = {}

# The fixture blocks a mixed-case tag; the library default is the reference's set.
FIXTURE_CFG = SearchConfig(limit=C.APP_SEARCH_LIMIT, blocked_tags=("nsfw",))


def fixture_inputs(spark: SparkSession, sf_dir: str):
    fx.register(spark, sf_dir, ("v_docs", "v_queries"))
    docs = spark.table("v_docs")
    emb = spark.table("embeddings")
    vectors = emb.join(docs.select("seq", "doc_id"), emb.vec_id == docs.seq).select("doc_id", "embedding")
    queries = spark.table("v_queries")
    qvec = queries.join(emb, "vec_id").select("query_id", "embedding")
    return docs, vectors, queries.select("query_id", "raw"), qvec


def fixture_store(spark: SparkSession, sf_dir: str, cfg: SearchConfig = FIXTURE_CFG) -> SearchStore:
    """The store of the fixture corpus with its given vectors, as ingest leaves it."""

    def write(path):
        docs, vectors, _, _ = fixture_inputs(spark, sf_dir)
        write_store(docs, path, vectors, cfg=cfg)

    return read_store(spark, built(spark, "fixture-store", [f"{sf_dir}/part.parquet", f"{sf_dir}/embeddings.parquet"], write), cfg)


def fixture_search(spark: SparkSession, sf_dir: str, cfg: SearchConfig = FIXTURE_CFG) -> Search:
    _, _, queries, qvec = fixture_inputs(spark, sf_dir)
    return search(queries, fixture_store(spark, sf_dir, cfg), None, qvec, cfg)


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), "doc_id",
                       round6("score").alias("score"), round6("list_score").alias("list_score"), "description")


def hybrid_search(spark: SparkSession, sf_dir: str, cfg: SearchConfig = FIXTURE_CFG) -> DataFrame:
    return _hits(fixture_search(spark, sf_dir, cfg).hits)


def search_totals(spark: SparkSession, sf_dir: str, cfg: SearchConfig = FIXTURE_CFG) -> DataFrame:
    return fixture_search(spark, sf_dir, cfg).totals.select(F.col("query_id").cast("long").alias("query_id"), "total")


def search_texts(spark: SparkSession, sf_dir: str, cfg: SearchConfig = FIXTURE_CFG) -> DataFrame:
    """I13 over a query table that grows with the data: every part's and every benchmark passage's query of v_query_texts,
    each form of the syntax, alone, mixed, empty or left open."""
    fx.register(spark, sf_dir, ("v_query_texts",))
    queries = spark.table("v_query_texts")
    vectors = queries.join(fx.table(spark, sf_dir, "embeddings"), "vec_id").select("query_id", "embedding")
    hits = search(queries.select("query_id", "raw"), fixture_store(spark, sf_dir, cfg), None, vectors, cfg).hits
    return hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), "doc_id", round6("list_score").alias("list_score"))


O["search_texts"] = fx.with_views("""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, doc_id, round(list_score, 6) AS list_score FROM hits""",
    "v_docs", "v_query_texts", ctes=search_ctes().replace("FROM v_queries", "FROM v_query_texts"))
Q["search_texts"] = search_texts


def text_only_search(spark: SparkSession, sf_dir: str, cfg: SearchConfig = FIXTURE_CFG) -> DataFrame:
    """I13 with K2: documents and queries are texts alone; the store's and the queries' vectors are the embedder's."""
    docs, _, queries, _ = fixture_inputs(spark, sf_dir)
    embedder = HashEmbedder()
    path = built(spark, "embedded-store", [f"{sf_dir}/part.parquet"], lambda path: write_store(docs, path, embedder=embedder, cfg=cfg))
    return _hits(search(queries, read_store(spark, path, cfg), cfg=cfg, embedder=embedder).hits)


O["text_only_search"] = fx.with_views("""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score,
       round(list_score, 6) AS list_score, description
FROM hits""", "v_docs", "v_queries", ctes=search_ctes(embedded=True))
Q["text_only_search"] = text_only_search
