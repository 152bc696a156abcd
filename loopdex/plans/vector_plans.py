"""Vector plans: exact and IVF kNN, the hash embedder, embedding attachment, RRF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.operators import pq as PQ
from loopdex.operators import vectors as V
from loopdex.operators.embedder import embed
from loopdex.operators.util import round6
from loopdex.plans.common import KNN_K, built
from loopdex.plans.oracle_search import hashed, search_ctes
from loopdex.plans.search_plans import fixture_search
from loopdex.session import written
from loopdex.sources import fixtures as fx

Q: dict = {}
O: dict = {}


def _vq(spark, sf):
    fx.register(spark, sf, ("v_queries",))
    emb = spark.table("embeddings")
    vecs = emb.select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    q = spark.table("v_queries").join(emb, "vec_id").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    return vecs, q


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    """I8: top-10 neighbours of every fixture query vector among all embeddings."""
    vecs, q = _vq(spark, sf)
    r = V.knn_exact(vecs, q, KNN_K)
    return r.select("query_id", F.col("vrank").cast("long").alias("rank"), "doc_id", round6("score").alias("score"))


O["knn_exact"] = fx.with_views(f"""
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT CAST(q.query_id AS BIGINT) AS query_id, CAST(e.vec_id AS VARCHAR) AS doc_id,
         list_dot_product(qe.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(qe.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC,
                            CAST(e.vec_id AS VARCHAR)) AS rank
  FROM v_queries q JOIN embeddings qe ON qe.vec_id = q.vec_id CROSS JOIN embeddings e)
WHERE rank <= {KNN_K}""", "v_queries")


def knn_ivf(spark: SparkSession, sf: str, n_cells: int = 16, nprobe: int | None = None) -> DataFrame:
    """IVF (KMeans cells) top-10 with recall against the exact list; as many probes as find
    the neighbours of held-out vectors, unless nprobe is given."""
    vecs, q = _vq(spark, sf)
    train, held = V.ivf_hold_out(vecs)
    model = V.ivf_train(train, n_cells)
    assigned = V.ivf_assign(vecs, model)
    approx = V.knn_ivf(assigned, q, model, KNN_K, nprobe or V.ivf_nprobe(assigned, held, model, KNN_K))
    exact = V.knn_exact(vecs, q, KNN_K)
    rec = V.recall_at_k(approx, exact.select("query_id", "doc_id"))
    return approx.select("query_id", F.col("vrank").cast("long").alias("rank"), "doc_id", round6("score").alias("score")).join(
        rec, "query_id")


def knn_pq(spark: SparkSession, sf: str) -> DataFrame:
    """The persisted index (cells, product-quantised residuals, exact rerank), with recall against the exact list."""
    vecs, q = _vq(spark, sf)
    index = PQ.read_index(spark, built(spark, "pq-index", [f"{sf}/embeddings.parquet"], lambda path: PQ.write_index(vecs, path, KNN_K)))
    approx = written(PQ.knn(index, q, KNN_K), "pq-found")
    rec = V.recall_at_k(approx, V.knn_exact(vecs, q, KNN_K).select("query_id", "doc_id"))
    return approx.select("query_id", F.col("vrank").cast("long").alias("rank"), "doc_id", round6("score").alias("score")).join(rec, "query_id")


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed, L2-normalised term counts of every document (non-zero buckets)."""
    docs = fx.table(spark, sf, "documents")
    e = V.hash_embed_sparse(docs, "doc_id", "text")
    return e.select("doc_id", F.col("bucket").cast("int").alias("bucket"), round6("weight").alias("weight"))


O["hash_embed"] = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS token FROM documents),
b AS (SELECT doc_id, CAST(CAST(concat('0x', substr(md5(token), 1, 8)) AS UBIGINT) % 384 AS INTEGER) AS bucket, count(*)::DOUBLE AS c
      FROM t GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM b GROUP BY doc_id)
SELECT doc_id, bucket, round(CAST(CAST(c / norm AS FLOAT) AS DOUBLE), 6) AS weight FROM b JOIN n USING (doc_id)"""


def attach_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Every fixture document with its vector flag (embeddings joined on seq)."""
    fx.register(spark, sf, ("v_docs",))
    docs = spark.table("v_docs").select("doc_id", "seq")
    vec = spark.table("embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    a = V.attach_embeddings(docs, vec, "seq")
    return a.select("doc_id", "embed_failed", F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("dim"))


O["attach_embeddings"] = fx.with_views("""
SELECT d.doc_id, e.embedding IS NULL AS embed_failed, CASE WHEN e.embedding IS NULL THEN -1 ELSE len(e.embedding) END AS dim
FROM v_docs d LEFT JOIN embeddings e ON e.vec_id = d.seq""", "v_docs")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Fused RRF scores of the text and vector lists of every hybrid query
    (before the search limit and moderation)."""
    found = fixture_search(spark, sf)
    f = found.fused().join(found.pq.where("mode = 'hybrid'").select("query_id"), "query_id")
    return f.select(F.col("query_id").cast("long").alias("query_id"), "doc_id", round6("fused").alias("fused"))


O["rrf_fuse"] = fx.with_views("""
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(fused, 6) AS fused FROM fused JOIN q USING (query_id) WHERE q.mode = 'hybrid'""",
    "v_docs", "v_queries", ctes=search_ctes(limit=20, depth=20, blocked=("nsfw",)))

def embed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage against every document, both as texts alone: the embedder's vectors, top 10."""
    docs = embed(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")
    queries = embed(fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text")
    r = V.knn_exact(docs, queries, KNN_K)
    return r.select("query_id", F.col("vrank").cast("long").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), round6("score").alias("score"))


O["embed_search"] = f"""
WITH {hashed("de", "documents", "doc_id", "text").strip()}, {hashed("qe", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text").strip()},
scored AS (SELECT query_id, doc_id, sum(qe.w * de.w) AS score FROM qe JOIN de USING (bucket) GROUP BY ALL)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scored) WHERE rank <= {KNN_K}"""

Q.update({"embed_search": embed_search, "knn_exact": knn_exact, "knn_ivf": knn_ivf, "knn_pq": knn_pq, "hash_embed": hash_embed, "attach_embeddings": attach_embeddings,
          "rrf_fuse": rrf_fuse})
