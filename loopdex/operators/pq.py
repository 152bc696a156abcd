"""A persisted approximate vector index: cells, product-quantised residuals, table-lookup scores, exact rerank.

Under the index folder:

  cells/     cell, centroid: a k-means quantiser fitted on at most SAMPLE vectors
  books/     part, words: for each of PARTS slices of the dimensions up to 256 words, fitted on the sample's residuals
             (vector less its cell's centroid), a task a slice
  codes/     cell (a folder), ids, codes: every vector as PARTS bytes, packed thousands to a row
  vectors/   cell (a folder), doc_id, embedding: for the rerank
  tuned/     probes, kept, recall: what the held-out vectors needed

A query reads the codes of its nearest cells alone. A table of its products with all words turns a code into a score by
PARTS look-ups and sums (q.x = q.centroid + q.residual); the best ``kept`` candidates are scored again with their own vectors,
read from the folders of their cells. ``probes`` and ``kept`` are the least of their doublings that find TARGET of the true
neighbours of vectors which were kept out of the fit.

Vectors are of one length (the first found; others and nulls are left out, as are null ids). An empty table is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.operators.knn import knn_exact
from loopdex.operators.util import round6, top_k_per_group
from loopdex.operators.vectors import dot, ivf_hold_out, ivf_train, recall_at_k
from loopdex.session import written

#: Vectors that quantisers are fitted on at most, cells at most, slices of the dimensions, and the recall asked of the
#: held-out vectors (above 0.9, as other queries scatter).
SAMPLE, MAX_CELLS, PARTS, TARGET = 65_536, 16_384, 8, 0.95
ROUNDS = 12
VECTORS_A_ROW, QUERIES_A_BLOCK = 8192, 1024
#: Rows of candidates that a task holds before it drops those that others of their query surpass.
HELD_ROWS = 1 << 20


@dataclass
class PqIndex:
    path: str
    cells: DataFrame
    codes: DataFrame
    vectors: DataFrame
    books: list[np.ndarray]
    probes: int = 0
    kept: int = 0


def _lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means words of the rows of x; words without rows take the rows that are served worst."""
    r = np.random.default_rng(seed)
    words = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        far = (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)
        near = far.argmin(1)
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
        empty = np.flatnonzero(count == 0)
        words[empty] = x[np.argsort(-far[np.arange(len(x)), near])[: len(empty)]]
    return words


def _slices(dim: int, parts: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest_cell(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (-2 * x @ centers.T + (centers * centers).sum(1)).argmin(1)


def write_index(vectors: DataFrame, path: str, k: int = 10, parts: int = PARTS, cells: int | None = None) -> PqIndex:
    """Build the index of vectors (doc_id, embedding) under path and tune it for k neighbours."""
    spark = vectors.sparkSession
    some = vectors.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    some = some.where(F.col("doc_id").isNotNull() & F.col("embedding").isNotNull())
    first = some.select(F.size("embedding").alias("dim")).first()
    if first is None:
        raise ValueError("no vectors to index")
    some = written(some.where(F.size("embedding") == first["dim"]), "pq-vectors")
    n, dim = some.count(), first["dim"]
    train, held = ivf_hold_out(some)
    sample = written(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "pq-sample")
    centers = np.stack(ivf_train(sample, min(cells or max(1, round(n**0.5)), MAX_CELLS)).clusterCenters()).astype(np.float64)
    slices = _slices(dim, parts)

    def residuals(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("embedding"))
                x -= centers[_nearest_cell(x, centers)]
                for i, (a, b) in enumerate(slices):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(list(x[:, a:b]), pa.list_(pa.float64()))], names=["part", "x"])

    def book(key, pdf):
        import pandas as pd

        words = _lloyd(np.stack(pdf["x"].to_numpy()), 256, key[0])
        return pd.DataFrame({"part": np.int32(key[0]), "words": [words.ravel().tolist()]})

    books = sample.mapInArrow(residuals, "part int, x array<double>").groupBy("part").applyInPandas(book, "part int, words array<double>")
    books.write.mode("overwrite").parquet(f"{path}/books")
    rows = [(i, c.tolist()) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    words = _books(spark, path, slices)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("embedding"))
            cell = _nearest_cell(x, centers)
            rest = x - centers[cell]
            codes = np.stack([_nearest_cell(rest[:, a:b], w) for (a, b), w in zip(slices, words)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["doc_id", "embedding", "cell", "code"])

    coded = written(some.mapInArrow(encode, "doc_id string, embedding array<float>, cell int, code binary"), "pq-coded")
    # A cell may hold a third of all rows: its rows are dealt to several tasks and files, each of thousands, however many cells.
    size = F.broadcast(coded.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(VECTORS_A_ROW)).alias("deals")))  # at most MAX_CELLS rows
    dealt = coded.join(size, "cell").withColumn("deal", F.pmod(F.xxhash64("doc_id"), "deals")).drop("deals")
    dealt.select("doc_id", "embedding", "cell", "deal").repartition("cell", "deal").drop("deal").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    packed = dealt.groupBy("cell", "deal").agg(F.sort_array(F.collect_list(F.struct("doc_id", "code"))).alias("rows"))
    packed.select("cell", F.transform("rows", lambda r: r["doc_id"]).alias("ids"), F.transform("rows", lambda r: r["code"]).alias("codes")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    index = read_index(spark, path, tuned=False)
    probes, kept, recall = _tune(index, some, held, k, len(centers))
    spark.createDataFrame([(probes, kept, recall)], "probes int, kept int, recall double").write.mode("overwrite").parquet(f"{path}/tuned")
    return read_index(spark, path)


def _books(spark: SparkSession, path: str, slices: list[tuple[int, int]]) -> list[np.ndarray]:
    """The words of each slice (256 words a slice: small whatever the number of vectors)."""
    rows = {r["part"]: r["words"] for r in spark.read.parquet(f"{path}/books").collect()}
    return [np.array(rows[i]).reshape(-1, b - a) for i, (a, b) in enumerate(slices)]


def read_index(spark: SparkSession, path: str, tuned: bool = True) -> PqIndex:
    cells = spark.read.schema("cell int, centroid array<double>").parquet(f"{path}/cells")
    dim, parts = len(cells.first()["centroid"]), spark.read.parquet(f"{path}/books").count()
    codes = spark.read.schema("ids array<string>, codes array<binary>, cell int").parquet(f"{path}/codes")
    vectors = spark.read.schema("doc_id string, embedding array<float>, cell int").parquet(f"{path}/vectors")
    index = PqIndex(path, cells, codes, vectors, _books(spark, path, _slices(dim, parts)))
    if tuned:
        row = spark.read.parquet(f"{path}/tuned").first()
        index.probes, index.kept = row["probes"], row["kept"]
    return index


def probed(index: PqIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, cell): the cells whose centroids have the largest product with each query."""
    centers = index.cells.select(F.col("cell").cast("string").alias("doc_id"), F.col("centroid").alias("embedding"))
    return knn_exact(centers, queries, probes).select("query_id", F.col("doc_id").cast("int").alias("cell"))


def _best_rows(held: list, kept: int):
    """The rows of batches (query_id, doc_id, cell, score) that score as well as their query's kept-th or better."""
    import pyarrow as pa

    rows = pa.Table.from_batches(held).combine_chunks()
    code = rows.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    score = np.nan_to_num(rows.column("score").to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf)  # NaN comes first, as in Spark
    order = np.lexsort((-score, code))
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    floor = score[order[np.minimum(starts + kept, ends) - 1]]
    return rows.take(pa.array(np.flatnonzero(score >= floor[code]))).combine_chunks().to_batches()[0]


def candidates(index: PqIndex, queries: DataFrame, probes: int, kept: int) -> DataFrame:
    """(query_id, doc_id, cell, score): the kept best of each query by looked-up scores in its cells."""
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = written(probed(index, asked, probes), "probes")
    # Folders of cells that no query asks for aren't read: at most MAX_CELLS numbers come here.
    names = [r["cell"] for r in wanted.select("cell").distinct().collect()]
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // QUERIES_A_BLOCK))))
    blocks = wanted.join(asked, "query_id").groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("queries"))
    rows = index.codes.where(F.col("cell").isin(names)).join(blocks, "cell").join(index.cells, "cell")
    books = index.books

    def run(batches):
        import pyarrow as pa

        names, held, size = ["query_id", "doc_id", "cell", "score"], [], 0
        for batch in batches:
            for i in range(len(batch)):
                ids, raw = batch.column("ids")[i].values, b"".join(batch.column("codes")[i].values.to_pylist())
                codes = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)
                asked = batch.column("queries")[i].values
                q, center = _matrix(asked.field("embedding")), np.array(batch.column("centroid")[i].as_py())
                at, score = 0, np.repeat((q @ center)[:, None], len(ids), axis=1)
                for m, words in enumerate(books):
                    table = q[:, at : at + words.shape[1]] @ words.T
                    score += table[:, codes[:, m]]
                    at += words.shape[1]
                keep = min(kept, len(ids))
                best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                row = np.repeat(np.arange(len(q)), keep)
                columns = [asked.field("query_id").take(pa.array(row)), ids.take(pa.array(best.ravel())), pa.array(np.full(len(row), batch.column("cell")[i].as_py(), np.int32)), pa.array(score[row, best.ravel()])]
                held, size = [*held, pa.RecordBatch.from_arrays(columns, names=names)], size + len(row)
                if size >= HELD_ROWS:
                    held = [_best_rows(held, kept)]
                    size = len(held[0])
                    if size >= HELD_ROWS // 2:  # many queries, few rows each
                        yield from held
                        held, size = [], 0
        if held:
            yield _best_rows(held, kept)

    kind = dict(queries.dtypes)["query_id"]
    found = rows.select("cell", "ids", "codes", "queries", "centroid").mapInArrow(run, f"query_id {kind}, doc_id string, cell int, score double")
    return top_k_per_group(found, "query_id", [F.col("score").desc(), F.col("doc_id")], kept, "place").drop("place")


def knn(index: PqIndex, queries: DataFrame, k: int, probes: int | None = None, kept: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, vrank): the k best candidates of each query (query_id, embedding) by their exact inner
    product; ties to smaller ids."""
    few = written(candidates(index, queries, probes or index.probes, max(k, kept or index.kept)).drop("score"), "pq-candidates")
    names = [r["cell"] for r in few.select("cell").distinct().collect()]
    rows = index.vectors.where(F.col("cell").isin(names)).join(few, ["cell", "doc_id"]).join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = rows.select("query_id", "doc_id", dot("embedding", "q").alias("score"))
    return top_k_per_group(scored, "query_id", [round6("score").desc(), F.col("doc_id")], k, "vrank")


def _tune(index: PqIndex, vectors: DataFrame, held: DataFrame, k: int, cells: int) -> tuple[int, int, float]:
    """(probes, kept, recall) for the held-out vectors, themselves left out of their neighbours."""
    if held.count() == 0:
        return cells, 1 << 20, 1.0
    own = held.select("query_id", "own")
    without = lambda df: top_k_per_group(df.join(own, "query_id").where("doc_id <> own").drop("vrank"), "query_id", [round6("score").desc(), F.col("doc_id")], k, "vrank")
    truth = written(without(knn_exact(vectors, held, k + 1)).select("query_id", "doc_id"), "pq-truth")
    kept, probes, recall = 8 * k, _least_probes(index, held, truth, cells), 0.0
    while True:
        last, most = recall, probes >= cells
        recall = recall_at_k(without(knn(index, held, k + 1, probes, kept)), truth).agg(F.avg("recall")).first()[0]
        if recall >= TARGET or most and (kept >= 1 << 16 or recall <= last and kept > 64 * k):
            return probes, kept, float(recall)
        if most:
            kept *= 4
        else:
            probes = min(cells, probes * 2)


def _least_probes(index: PqIndex, held: DataFrame, truth: DataFrame, cells: int) -> int:
    """The least doubling of probes whose cells hold TARGET of the true neighbours: fewer can't find as many, so none is tried."""
    centers = index.cells.select(F.col("cell").cast("string").alias("doc_id"), F.col("centroid").alias("embedding"))
    place = knn_exact(centers, held, cells).select("query_id", F.col("doc_id").cast("int").alias("cell"), "vrank")
    at = index.vectors.select("doc_id", "cell").join(F.broadcast(truth), "doc_id").join(place, ["query_id", "cell"])
    at = truth.join(at.groupBy("query_id", "doc_id").agg(F.min("vrank").alias("place")), ["query_id", "doc_id"], "left")
    tries = [1]
    while tries[-1] < cells:
        tries.append(min(cells, tries[-1] * 2))
    # A column a doubling: the share of the neighbours of each query, then their mean.
    shares = at.groupBy("query_id").agg(*[F.avg(F.coalesce((F.col("place") <= p).cast("double"), F.lit(0.0))).alias(f"p{p}") for p in tries])
    means = shares.agg(*[F.avg(f"p{p}") for p in tries]).first()
    return next((p for p, mean in zip(tries, means) if mean is not None and mean >= TARGET - 1e-9), cells)
