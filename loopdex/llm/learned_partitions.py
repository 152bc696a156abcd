"""Nearest neighbours by learned partitions: a balanced partitioning of a neighbour graph, a small classifier that
predicts the partition of any vector, and queries that rerank exactly inside their most probable partitions.

Fitting uses a bounded sample (SAMPLE vectors, those with the smallest id hash): its exact neighbour graph is cut into
PARTS balanced parts (median splits along principal directions, then moves towards the neighbours' majority as long as
the sizes stay balanced), and a one-layer network learns the parts, with the neighbours' parts as soft labels. This is
the only step on the driver; its size doesn't depend on the table. Every vector of the table is then indexed.
How many parts a query reads follows from the classifier: the most probable ones until they hold a share of the
probability that, on a part of the sample kept out of training, found TARGET of the true neighbours. Clustered vectors
need few parts for that, vectors without structure nearly all; recall comes first.

Searching: a part's vectors are cut into blocks and its queries into blocks, and each pair of blocks is a task of
bounded size, whatever part holds most vectors (say, one very common vector). A task returns its k best a query; the
last step keeps k of those.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors whose length
isn't the most common one; ties go to the smaller vec_id; repeated rows are candidates each, but a query's own vec_id
never is; a query that is stored twice is one query, and different vectors under one id are a query each; vectors keep
their precision (float or double); with fewer than k candidates all are returned, as queries then read every part; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loopdex.llm.common import written

SAMPLE = 8192
PARTS = 16
TARGET = 0.95
KEPT_OUT = 1024
NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 30
VECTORS_A_BLOCK = 16_384
QUERIES_A_BLOCK = 1024


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) without the vectors that take no part."""
    v = F.col("vector")
    kept = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    df = df.select(F.col(vec_id).cast("long").alias("vec_id"), kept.alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest rows of each row (its own left out)."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    norm = (x * x).sum(1)
    for at in range(0, len(x), 1024) if k > 0 else ():
        d = norm[None, :] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 10, slack: float = 0.1) -> np.ndarray:
    """A part of each row: equal halves again and again, then moves that cut fewer edges and keep the balance."""
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            centred = x[g] - x[g].mean(0) if len(g) else x[g]
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1] if len(g) else None
            g = g[np.argsort(centred @ axis, kind="stable")] if len(g) else g
            halves += [g[: len(g) // 2], g[len(g) // 2 :]]
        groups = halves
    for i, g in enumerate(groups):
        part[g] = i
    low, high = len(x) / len(groups) * (1 - slack), len(x) / len(groups) * (1 + slack)
    near = [[] for _ in range(len(x))]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            near[a].append(b)
            near[b].append(a)
    size = np.bincount(part, minlength=len(groups))
    for _ in range(rounds):
        moved = 0
        for a in range(len(x)):
            if near[a]:
                votes = np.bincount(part[near[a]], minlength=len(groups))
                best, own = int(votes.argmax()), int(part[a])
                if votes[best] > votes[own] and size[best] + 1 <= high and size[own] - 1 >= low:
                    size[best] += 1
                    size[own] -= 1
                    part[a] = best
                    moved += 1
        if not moved:
            break
    return part


class Classifier:
    """A network with one hidden layer, trained by Adam on soft labels; small enough to be sent to every worker."""

    def __init__(self, dim: int, parts: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden), r.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        self.mean, self.scale, self.share = np.zeros(dim), 1.0, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 2e-3) -> Classifier:
        self.mean, self.scale = x.mean(0), float(x.std()) or 1.0
        x, r, t = (x - self.mean) / self.scale, np.random.default_rng(11), 0
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                i, t = order[at : at + batch], t + 1
                h, p = self._forward(x[i])
                dz = (p - y[i]) / len(i)
                dh = (dz @ self.w[2].T) * (h > 0)
                for j, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] = self.w[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return self

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(1, keepdims=True))
        return h, z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each part, a row a vector."""
        return self._forward((x - self.mean) / self.scale)[1]


def _share(classifier: Classifier, x: np.ndarray, queries: np.ndarray, target: float, k: int = NEIGHBOURS) -> float:
    """The smallest share of probability, in hundredths, whose parts hold `target` of the queries' k nearest in x."""
    own = classifier.predict(x).argmax(1)
    p = classifier.predict(queries)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
    d = (x * x).sum(1)[None, :] - 2 * queries @ x.T
    near = own[np.argpartition(d, k, axis=1)[:, :k]]
    # The share that is passed before a neighbour's part is reached.
    needed = np.take_along_axis(before, np.take_along_axis(np.argsort(order, 1), near, 1), 1)
    return min(1.0, float(np.ceil(np.quantile(needed, target) * 100) / 100) + 0.01)


def fit(vectors: DataFrame, parts: int = PARTS, sample: int = SAMPLE, target: float = TARGET) -> Classifier | None:
    """The classifier of vectors (vec_id, vector), with the share of probability that a query reads; None if there are
    no vectors."""
    rows = vectors.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample + KEPT_OUT).collect()
    if not rows:
        return None
    x = np.array([r["vector"] for r in rows], np.float64)
    out = min(KEPT_OUT, len(x) // 8)
    queries, x = x[:out], x[out:]
    graph = neighbour_graph(x)
    part = balanced_parts(x, graph, parts)
    count = int(part.max()) + 1
    y = np.zeros((len(x), count))
    y[np.arange(len(x)), part] = 1
    for column in graph.T:
        y[np.arange(len(x)), part[column]] += 1
    classifier = Classifier(x.shape[1], count).fit(x, y / y.sum(1, keepdims=True))
    if out >= 30:  # too few to tell: read all
        classifier.share = _share(classifier, x, queries, target)
    return classifier


def _kind(vectors: DataFrame) -> str:
    """The numpy type of the vectors' components: what they are stored and measured in loses nothing."""
    return "<f4" if dict(vectors.dtypes)["vector"] == "array<float>" else "<f8"


def indexed(vectors: DataFrame, classifier: Classifier) -> DataFrame:
    """(vec_id, vector as bytes of its own precision, part, order: all parts, most probable first, probes: how many of them a query
    reads) of every vector."""
    sent, kind = vectors.sparkSession.sparkContext.broadcast(classifier), _kind(vectors)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("vector").to_pylist(), kind).reshape(batch.num_rows, -1)
            if batch.num_rows:
                p = sent.value.predict(x.astype(np.float64))
                order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
                p = np.take_along_axis(p, order, 1)
                probes = (np.cumsum(p, 1) - p < sent.value.share).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(order[:, 0]), pa.array(list(order), pa.list_(pa.int32())), pa.array(probes)],
                    names=["vec_id", "vector", "part", "order", "probes"],
                )

    return vectors.mapInArrow(run, "vec_id bigint, vector binary, part int, order array<int>, probes int")


def search(index: DataFrame, queries: DataFrame, k: int = 10, kind: str = "<f4") -> DataFrame:
    """(query_id, rank, vec_id, score): for queries (rows like the index's) their k nearest rows of the index found,
    by Euclidean distance in double precision. kind: the type of the components in the vectors' bytes."""
    # Equal rows are one query; rows that share an id but not the vector are queries of their own.
    queries = queries.withColumn("version", F.xxhash64("vector")).dropDuplicates(["vec_id", "version"])
    count = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    # A query reads its first `probes` parts, and further ones until they hold more than k vectors.
    held = F.transform("order", lambda p: F.coalesce(F.get(F.array(*[F.lit(count.get(i, 0)) for i in range(max(count, default=0) + 1)]), p), F.lit(0)))
    queries = queries.withColumn("held", held)
    before = F.transform(F.sequence(F.lit(0), F.size("order") - 1), lambda i: F.aggregate(F.slice("held", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x))
    read = F.filter(F.transform("order", lambda p, i: F.when((i < F.col("probes")) | (F.get(before, i) <= k), p)), lambda p: p.isNotNull())
    queries = queries.select("vec_id", "version", "vector", F.explode(read).alias("part"))
    asked = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = lambda of, size: F.element_at(F.create_map(*[F.lit(x) for p in sorted(set(count) | set(asked) | {-1}) for x in (p, max(1, -(-of.get(p, 0) // size)))]), F.col("part"))
    v_blocks, q_blocks = blocks(count, VECTORS_A_BLOCK), blocks(asked, QUERIES_A_BLOCK)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.where(F.col("part").isin(list(asked))).select("part", deal(v_blocks).alias("vb"), every(q_blocks).alias("qb"), "vec_id", "vector")
    right = queries.select("part", deal(q_blocks).alias("qb"), every(v_blocks).alias("vb"), "vec_id", "version", "vector")

    def best(vectors, queries):
        import pandas as pd

        out = []
        if len(vectors) and len(queries):
            ids = vectors["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            x = np.frombuffer(b"".join(vectors["vector"].to_numpy()[order]), kind).reshape(len(ids), -1).astype(np.float64)
            for q, version, raw in zip(queries["vec_id"], queries["version"], queries["vector"], strict=True):
                d = np.sqrt(((x - np.frombuffer(raw, kind).astype(np.float64)) ** 2).sum(1))
                d[ids == q] = np.inf
                n = min(k, int((ids != q).sum()))
                near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])[: len(d)] if n else np.zeros(0, np.int64)
                near = near[np.argsort(d[near], kind="stable")][:n]  # ids ascend, so ties keep the smaller
                out.append(pd.DataFrame({"query_id": q, "version": version, "vec_id": ids[near], "score": d[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "version": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "version": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["part", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id bigint, version bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "version").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def common_length(vectors: DataFrame) -> int:
    """The most common vector length (ties: the smaller); 0 without vectors."""
    top = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return top["n"] if top else 0


def nearest(df: DataFrame, every: int = 100, k: int = 10, **how) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by `every`."""
    vectors = usable(df)
    vectors = vectors.where(F.size("vector") == common_length(vectors)).where("vec_id IS NOT NULL")
    classifier = fit(vectors, **how)
    if classifier is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = written(indexed(vectors, classifier), "index")
    return search(index, index.where(F.col("vec_id") % every == 0), k, _kind(vectors))
