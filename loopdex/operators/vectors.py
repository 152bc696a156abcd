"""Approximate vector retrieval by cells (I9), the built-in embedder's sparse form (I14) and embedding attachment.

Exact search is in ``knn``, the pluggable embedder in ``embedder``. Score [defined here]: inner product in float64 (= cosine
for unit vectors).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopdex import config as C
from loopdex.functions.text import tokens
from loopdex.operators.knn import knn_exact
from loopdex.operators.util import bounded_broadcast, spread, top_k_per_group
from loopdex.session import written

# IVF: held-out queries at most, the share of their neighbours that probes must find (above the
# 0.9 asked, as other queries scatter), and probe rows (with a query vector each) that are broadcast.
HELD_OUT, RECALL_TARGET, MAX_PROBE_ROWS = 256, 0.95, 10_000

#: Documents of a task of the sparse embedder, each at most ``dim`` rows of its aggregates.
EMBED_ROWS = 5_000


def dot(a, b):
    """Inner product as a native expression (small-input path and check)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


# ---------------------------------------------------------------------------- I14

def hash_buckets(text_col, dim: int = C.TEXT_DIM, pattern: str = "[\\p{L}\\p{N}]+"):
    """Feature-hash bucket per token: first 8 hex digits of md5(token) mod dim (native)."""
    return F.transform(tokens(text_col, pattern),
                       lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def hash_embed_sparse(df: DataFrame, id_col: str, text_col: str, dim: int = C.TEXT_DIM) -> DataFrame:
    """I14, sparse form, fully JVM-side: (id, bucket, weight) for the non-zero buckets.

    Rows are spread on the id, at most some EMBED_ROWS a task, so the (id, bucket) count and the
    per-document norm (a window over at most ``dim`` rows) reuse that partitioning: no further exchange.
    Weights are rounded to float32 exactly as the dense embedder stores them.
    """
    d = spread(df.select(id_col, text_col), id_col, EMBED_ROWS)
    counts = (d.select(id_col, F.explode(hash_buckets(text_col, dim)).alias("bucket"))
              .groupBy(id_col, "bucket").agg(F.count(F.lit(1)).cast("double").alias("c")))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(id_col)))
    return counts.select(id_col, "bucket", (F.col("c") / norm).cast("float").alias("weight"))


def attach_embeddings(docs: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Docs left-joined with their vector; ``embed_failed`` marks docs without one."""
    return (docs.join(vectors.select(key, "embedding"), key, "left")
            .withColumn("embed_failed", F.col("embedding").isNull()))


# ---------------------------------------------------------------------------- I9

def ivf_train(vectors: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 20):
    """Coarse quantiser: MLlib KMeans on the vectors (distributed Lloyd iterations)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.select(array_to_vector("embedding").alias("features"))
    return KMeans(k=n_cells, seed=seed, maxIter=max_iter, initMode="k-means||").fit(feats)


def ivf_assign(vectors: DataFrame, model) -> DataFrame:
    """Adds ``cell``; persist the result partitioned by cell to prune unprobed cells."""
    from pyspark.ml.functions import array_to_vector

    return (model.transform(vectors.withColumn("features", array_to_vector("embedding")))
            .withColumnRenamed("prediction", "cell").drop("features"))


def ivf_probes(queries: DataFrame, model, nprobe: int) -> DataFrame:
    """(query_id, cell, probe) for the nprobe nearest centroids of each query, probe = 1 the
    nearest (centroids are bounded by the cell count and already on the driver from the model)."""
    spark = queries.sparkSession
    cent = spark.sparkContext.broadcast(np.stack(model.clusterCenters()).astype(np.float64))

    def run(it):
        c = cent.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            qm = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
            d = ((qm[:, None, :] - c[None, :, :]) ** 2).sum(-1)
            order = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(dtype=np.int64), order.shape[1]),
                                "cell": order.reshape(-1).astype(np.int32),
                                "probe": np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(order))})

    return queries.select("query_id", "embedding").mapInPandas(run, "query_id long, cell int, probe int")


def ivf_hold_out(vectors: DataFrame, most: int = HELD_OUT) -> tuple[DataFrame, DataFrame]:
    """(vectors to train on, held-out queries): up to ``most`` vectors, at most a quarter of the
    table, chosen by the hash of their id. The queries keep their id as ``own``."""
    some = vectors.where(F.col("embedding").isNotNull())
    m = min(most, some.count() // 4)
    picked = some.select(F.col("doc_id").cast("string").alias("own"), "embedding").orderBy(F.xxhash64("own"), "own").limit(m)
    held = written(picked.select(F.monotonically_increasing_id().alias("query_id"), "own", "embedding"), "ivf_held")
    train = some.join(F.broadcast(held.select("own")), F.col("doc_id").cast("string") == F.col("own"), "left_anti")
    return train, held


def ivf_nprobe(assigned: DataFrame, held: DataFrame, model, k: int, target: float = RECALL_TARGET) -> int:
    """The fewest probes that find ``target`` of the held-out queries' true k neighbours (themselves
    left out); all cells where there is nothing to measure on. The driver gets a count a probe."""
    cells = len(model.clusterCenters())
    near = knn_exact(assigned, held, k + 1).join(F.broadcast(held.select("query_id", "own")), "query_id").where("doc_id <> own")
    near = top_k_per_group(near.drop("vrank"), "query_id", [F.col("score").desc(), F.col("doc_id")], k)
    found = (assigned.select(F.col("doc_id").cast("string").alias("doc_id"), "cell")
             .join(F.broadcast(near.select("query_id", "doc_id")), "doc_id")
             .join(F.broadcast(ivf_probes(held, model, cells)), ["query_id", "cell"])
             .groupBy("query_id", "doc_id").agg(F.min("probe").alias("probe")))
    count = dict(found.groupBy("probe").count().collect())
    need, got = target * sum(count.values()), 0
    for n in range(1, cells + 1):
        got += count.get(n, 0)
        if got and got >= need:
            return n
    return cells


def knn_ivf(assigned: DataFrame, queries: DataFrame, model, k: int, nprobe: int) -> DataFrame:
    """Approximate top-k: score only vectors in the probed cells (equi-join on cell)."""
    probes = ivf_probes(queries, model, nprobe).join(queries.select("query_id", F.col("embedding").alias("q_emb")), "query_id")
    cand = assigned.select("doc_id", "cell", "embedding").join(bounded_broadcast(probes, MAX_PROBE_ROWS), "cell")
    scored = cand.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), dot("embedding", "q_emb").alias("score"))
    return top_k_per_group(scored, "query_id", [F.col("score").desc(), F.col("doc_id")], k, "vrank")


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per-query recall of approx against exact top-k lists (query_id, recall)."""
    hit = exact.join(approx.select("query_id", "doc_id", F.lit(1).alias("found")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("found", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
