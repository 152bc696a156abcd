"""The written search store: everything that ``search`` reads, made once at ingest.

Under one folder: ``text`` (the inverted index of ``inverted``), ``tags`` (the bitmaps of ``tag_bitmaps``), ``orders`` (the
store order of each range), ``vectors`` (a row a vector in order of range and local, as a reader holds thousands of rows,
however well they compress; searches pack them) and ``rows`` (the display fields). All but ``rows`` speak of documents as
(range, local).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.config import SearchConfig
from loopdex.functions.query import tag_tokens
from loopdex.operators.embedder import Embedder, embed
from loopdex.operators.inverted import RANGE_DOCS, TextIndex, read_index, write_index
from loopdex.operators.knn import best, query_blocks
from loopdex.operators.store import exists
from loopdex.operators.tag_bitmaps import Masks, TagIndex, bit_at, read_tags, write_tags
from loopdex.operators.util import ensure_cols, round6, top_k_per_group

#: Bytes of the vectors of a packed row.
ROW_BYTES = 1 << 20
DISPLAY_COLS = ("literal", "description", "original_description", "combined_text", "tags", "gif_url")


@dataclass
class SearchStore:
    text: TextIndex
    tags: TagIndex
    orders: DataFrame
    rows: DataFrame
    vectors: DataFrame | None


def write_store(docs: DataFrame, path: str, vectors: DataFrame | None = None, embedder: Embedder | None = None, text_col: str = "combined_text",
                cfg: SearchConfig = SearchConfig(), range_docs: int = RANGE_DOCS) -> SearchStore:
    """Write the store of docs (doc_id, seq, combined_text, tags and display fields; a row a document) under path.

    Vectors are those of vectors (doc_id, embedding), or are made by embedder from the text; a document without a vector, or
    whose embedding failed, is only missing from the vector list."""
    docs = ensure_cols(docs, ("literal", "description", "original_description", "combined_text", "gif_url"))
    if "tags" not in docs.columns:
        docs = docs.withColumn("tags", F.lit(None).cast("array<string>"))
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("string"), "seq": F.col("seq").cast("long")})
    prepared = docs.select("doc_id", "seq", F.col(text_col).alias("_text"), tag_tokens("tags").alias("tag_toks"))
    index = write_index(prepared, f"{path}/text", "_text", carry=("seq", "tag_toks"), cfg=cfg, range_docs=range_docs)
    write_tags(index.docs, f"{path}/tags")
    seqs = F.sort_array(F.collect_list(F.struct("local", "seq")))  # a range's documents are few
    orders = index.docs.groupBy("range").agg(F.min("seq").alias("first"), F.transform(seqs, lambda x: x["seq"]).alias("seqs"))
    orders.write.mode("overwrite").parquet(f"{path}/orders")
    docs.select("doc_id", *DISPLAY_COLS).write.mode("overwrite").parquet(f"{path}/rows")
    if vectors is None and embedder is not None:
        vectors = embed(docs.select("doc_id", F.col(text_col).alias("_text")), "_text", embedder)
    if vectors is not None:
        some = vectors.where(F.col("embedding").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "embedding")
        placed = some.join(index.docs.select("doc_id", "range", "local").hint("merge"), "doc_id")
        placed.select("range", "local", "embedding").repartition("range").sortWithinPartitions("range", "local").write.mode("overwrite").parquet(f"{path}/vectors")
    return read_store(docs.sparkSession, path, cfg)


def packed(vectors: DataFrame) -> DataFrame:
    """(range, dim, locals, values) of vectors (range, local, embedding): neighbours in a range of one length, their
    components as bytes, at most ROW_BYTES a row."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select("range", "local", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            number, vectors = batch.column("range").to_numpy(), batch.column("embedding")
            ends, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            dims = np.diff(ends)
            new = np.flatnonzero((np.diff(number) != 0) | (np.diff(dims) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)]):
                step = max(1, ROW_BYTES // max(1, values.itemsize * int(dims[a])))
                cuts = [*range(a, b, step), b]
                row = [pa.array(number[cuts[:-1]]), pa.array(dims[cuts[:-1]].astype(np.int32)),
                       pa.array([batch.column("local").to_numpy()[i:j] for i, j in zip(cuts, cuts[1:])], pa.list_(pa.int32())),
                       pa.array([values[ends[i] : ends[j]].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["range", "dim", "locals", "values"])

    return rows.mapInArrow(run, "range bigint, dim int, locals array<int>, values binary")


def read_store(spark: SparkSession, path: str, cfg: SearchConfig = SearchConfig()) -> SearchStore:
    vectors = spark.read.parquet(f"{path}/vectors") if exists(spark, f"{path}/vectors") else None
    return SearchStore(read_index(spark, f"{path}/text", cfg), read_tags(spark, f"{path}/tags"), spark.read.parquet(f"{path}/orders"), spark.read.parquet(f"{path}/rows"), vectors)


def nearest(store: SearchStore, queries: DataFrame, k: int, masks: Masks) -> DataFrame:
    """I8: (query_id, range, local, doc_id, score, vrank): the k documents of largest inner product with each query
    (query_id, embedding), in double precision, among those its mask allows; ties to smaller ids."""
    asked = queries.select("query_id", "embedding").join(masks.of.select("query_id", "filter"), "query_id")
    blocks, few = query_blocks(asked)
    # A range meets the blocks that have a filter which leaves any of it, with the masks of that block's filters.
    used = blocks.select("block", F.explode(F.array_distinct(F.transform("queries", lambda q: q["filter"]))).alias("filter"))
    used = masks.bits.join(used, "filter").groupBy("range", "block").agg(F.collect_list(F.struct("filter", "mask")).alias("masks"))
    # Vectors are far larger than their files, so their size mustn't suggest a broadcast of them.
    rows = packed(store.vectors).hint("merge").join(used, "range").join(F.broadcast(blocks) if few else blocks, "block")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                local, dim, values = batch.column("locals")[i].values.to_numpy(), batch.column("dim")[i].as_py(), batch.column("values")[i].as_buffer()
                values = np.frombuffer(values, np.float32 if values.size == 4 * dim * len(local) else np.float64)
                bits = {m["filter"]: m["mask"] for m in batch.column("masks")[i].as_py()}
                allowed = lambda name: np.flatnonzero(bit_at(bits[name], local)) if name in bits else None  # noqa: B023, E731
                asked = batch.column("queries")[i].values
                q, j, score = best(values.astype(np.float64).reshape(len(local), dim), asked, k, allowed)
                columns = [asked.field("query_id").take(pa.array(q)), pa.array(np.full(len(q), batch.column("range")[i].as_py(), np.int64)), pa.array(local[j].astype(np.int32)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "range", "local", "score"])

    kind = dict(asked.dtypes)["query_id"]
    found = rows.select("range", "dim", "locals", "values", "masks", "queries").mapInArrow(run, f"query_id {kind}, range bigint, local int, score double")
    named = found.join(store.text.docs.select("range", "local", "doc_id"), ["range", "local"])
    return top_k_per_group(named, "query_id", [round6("score").desc(), F.col("doc_id")], k, "vrank")
