"""Exact nearest neighbours by inner product for tables of queries.

Vectors come packed, thousands to a row, queries in blocks of QUERIES_A_BLOCK; a row of vectors meets every block once and
leaves at most k rows a query, so no (query, document) pair leaves a task. Blocks of few bytes are broadcast (they are
counted first); otherwise vectors and blocks are dealt to buckets by one equi-join, blocks copied to each. The kernel
and the memory of a task are the same either way: one packed row, one block and their product.

A filter is a name that a query may carry; a packed row then has a mask (bitmap over locals) for each filter that allows
any of its documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopdex.operators.util import round6, top_k_per_group

QUERIES_A_BLOCK = 1024
VECTORS_A_ROW = 4096
#: Bytes of query vectors that are broadcast at most.
MAX_BROADCAST_BYTES = 32 << 20


def query_blocks(queries: DataFrame) -> tuple[DataFrame, bool]:
    """(rows (block, queries), may they be broadcast?) of queries (query_id, embedding, filter)."""
    some = queries.where(F.col("embedding").isNotNull())
    n, size = some.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERIES_A_BLOCK)))).cast("int")
    blocks = some.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query_id", "filter", "embedding")).alias("queries"))
    return blocks, 8 * size <= MAX_BROADCAST_BYTES


def meet(packed: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """Each packed row with each block of queries."""
    blocks, few = query_blocks(queries)
    if few:
        return packed.withColumn("deal", F.lit(0)).join(F.broadcast(blocks.withColumn("deal", F.lit(0))), "deal").drop("deal")
    deals = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return packed.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(deals)).cast("int")).join(blocks, "deal").drop("deal")


def best(vectors: np.ndarray, asked, k: int, allowed=None):
    """(places in asked, rows of vectors, scores): the k rows of largest inner product for each query of an Arrow struct
    array (query_id, filter, embedding); ties to earlier rows. allowed(filter): the rows it may have, or None."""
    names = np.array([x or "" for x in asked.field("filter").to_pylist()])
    return best_of(vectors, names, *matrix_of(asked.field("embedding"), vectors.shape[1]), k, allowed)


def matrix_of(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of those of an Arrow list array that have the length dim."""
    ends = vectors.offsets.to_numpy()
    fits = np.flatnonzero(np.diff(ends) == dim)
    at = np.concatenate([np.arange(a, b) for a, b in zip(ends[fits], ends[fits + 1])]) if len(fits) else np.zeros(0, np.int64)
    return fits, vectors.values.to_numpy(zero_copy_only=False)[at].astype(np.float64).reshape(len(fits), dim)


def best_of(vectors: np.ndarray, names: np.ndarray, fits: np.ndarray, matrix: np.ndarray, k: int, allowed=None, least: np.ndarray | None = None):
    """``best`` for the queries at the places fits, whose filters are names[fits] and whose vectors are the rows of matrix. Rows whose
    rounded score is under a query's least (by place) are left out, where it is given. A query's rows are next to each other."""
    out = []
    for name in np.unique(names[fits]).tolist():
        rows = np.arange(len(vectors)) if allowed is None else allowed(name)
        every = np.flatnonzero(names[fits] == name)
        if rows is None or not len(rows):
            continue
        for i in range(0, len(every), QUERIES_A_BLOCK):
            mine = every[i : i + QUERIES_A_BLOCK]
            scores = matrix[mine] @ vectors[rows].T
            if least is not None:  # most queries have none left after some ranges
                some = np.flatnonzero((scores >= least[fits[mine]][:, None] - 1e-6).any(1))
                mine, scores = mine[some], scores[some]
                if not len(mine):
                    continue
            ranked = np.round(scores, 6)
            floor = np.partition(ranked, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(mine), -np.inf)
            if least is not None:
                floor = np.maximum(floor, least[fits[mine]])
            q, j = np.nonzero(ranked >= floor[:, None])
            order = np.lexsort((j, -ranked[q, j], q))
            q, j = q[order], j[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((fits[mine[q[keep]]], rows[j[keep]], scores[q[keep], j[keep]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def pack(vectors: DataFrame) -> DataFrame:
    """(row, ids, values): vectors (doc_id, embedding) of one length, ids in order, at most VECTORS_A_ROW a row."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import compute

        for batch in batches:
            # Ids in order, so that ties within a row go to smaller ids.
            batch = batch.take(compute.sort_indices(batch, sort_keys=[("doc_id", "ascending")]))
            ids, vectors = batch.column("doc_id"), batch.column("embedding")
            length = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(length).tolist():
                at = np.flatnonzero(length == dim)
                for i in range(0, len(at), VECTORS_A_ROW):
                    take = pa.array(at[i : i + VECTORS_A_ROW])
                    flat = vectors.take(take).flatten()
                    ends = pa.array([0, len(take)], pa.int32())
                    row = [pa.ListArray.from_arrays(ends, ids.take(take)), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
                    yield pa.RecordBatch.from_arrays([row[0].slice(0, 1).flatten().slice(0, 1), *row], names=["row", "ids", "values"])

    kinds = dict(vectors.dtypes)
    some = vectors.select("doc_id", "embedding").where(F.col("embedding").isNotNull() & F.col("doc_id").isNotNull())
    item = kinds["embedding"][6:-1]
    return some.mapInArrow(run, f"row {kinds['doc_id']}, ids array<{kinds['doc_id']}>, values array<{item}>")


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """I8: (query_id, doc_id, score, vrank): the k vectors (doc_id, embedding) of largest inner product with each query
    (query_id, embedding), in double precision; ranked as rounded to six decimals, ties to smaller ids. Vectors of another
    length have no score."""
    vectors = vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "embedding")
    queries = queries.select("query_id", "embedding", F.lit("").alias("filter"))
    rows = meet(pack(vectors), "row", queries)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                ids, values = batch.column("ids")[i].values, batch.column("values")[i].values.to_numpy(zero_copy_only=False)
                asked = batch.column("queries")[i].values
                q, j, score = best(values.astype(np.float64).reshape(len(ids), -1), asked, k)
                columns = [asked.field("query_id").take(pa.array(q)), ids.take(pa.array(j)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "score"])

    found = rows.select("ids", "values", "queries").mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, doc_id string, score double")
    return top_k_per_group(found, "query_id", [round6("score").desc(), F.col("doc_id")], k, "vrank")
