"""The persisted product-quantised index against exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopdex.operators import pq
from loopdex.operators.knn import knn_exact
from loopdex.operators.vectors import recall_at_k


def clusters(n, dim, k, spread, seed=1):
    r = np.random.default_rng(seed)
    at = r.normal(size=(k, dim))
    x = at[r.integers(k, size=n)] + spread * r.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, name="doc_id", start=0):
    rows = [(str(i + start) if name == "doc_id" else i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} {'string' if name == 'doc_id' else 'long'}, embedding array<float>")


def size(paths):
    return sum(os.path.getsize(p.removeprefix("file://")) for p in paths)


def test_recall_and_bytes_on_clusters(spark, tmp_dir):
    """Queries near a few clusters: recall of 0.9 or more from less than a quarter of the bytes of all vectors."""
    x = clusters(6000, 32, 40, 0.25)
    vectors = frame(spark, x)
    index = pq.write_index(vectors, f"{tmp_dir}/pq", 10, cells=40)
    tuned = spark.read.parquet(f"{tmp_dir}/pq/tuned").first()
    assert tuned.recall >= 0.9 and tuned.probes < 40
    r = np.random.default_rng(8)
    queries = frame(spark, x[:3] + 0.02 * r.normal(size=(3, 32)).astype(np.float32), "query_id")
    found = pq.knn(index, queries, 10)
    assert recall_at_k(found, knn_exact(vectors, queries, 10).select("query_id", "doc_id")).agg(F.avg("recall")).first()[0] >= 0.9
    few = pq.candidates(index, queries, index.probes, index.kept)
    cells = [c.cell for c in pq.probed(index, queries, index.probes).select("cell").distinct().collect()]
    reread = [c.cell for c in few.select("cell").distinct().collect()]
    # The files of other cells' folders are what the scan prunes.
    pruned = lambda df, names: [p for p in df.inputFiles() if any(f"/cell={c}/" in p for c in names)]
    assert size(pruned(index.codes, cells)) + size(pruned(index.vectors, reread)) < size(index.vectors.inputFiles()) / 4
    plan = index.codes.where(F.col("cell").isin(cells))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan
    assert index.codes.select(F.explode("ids")).count() == index.vectors.count() == 6000  # every row is indexed


def test_recall_without_structure(spark, tmp_dir):
    """Vectors without clusters need more probes and candidates; the tuning finds them."""
    x = np.random.default_rng(3).normal(size=(1500, 16)).astype(np.float32)
    vectors = frame(spark, x)
    index = pq.write_index(vectors, f"{tmp_dir}/pq", 10)
    queries = frame(spark, np.random.default_rng(4).normal(size=(30, 16)).astype(np.float32), "query_id")
    got = recall_at_k(pq.knn(index, queries, 10), knn_exact(vectors, queries, 10).select("query_id", "doc_id"))
    assert got.agg(F.avg("recall")).first()[0] >= 0.9


def test_pq_edges(spark, tmp_dir):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), (None, [1.0, 1.0]), ("d", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id string, embedding array<double>")
    index = pq.write_index(vectors, f"{tmp_dir}/pq", 2)
    queries = spark.createDataFrame([(1, [2.0, 1.0]), (2, None)], "query_id long, embedding array<double>")
    assert [(r.query_id, r.doc_id, r.score) for r in sorted(pq.knn(index, queries, 2).collect(), key=lambda r: r.vrank)] == [(1, "a", 2.0), (1, "d", 2.0)]
    assert pq.knn(index, queries.limit(0), 2).collect() == []
    with pytest.raises(ValueError, match="no vectors"):
        pq.write_index(vectors.limit(0), f"{tmp_dir}/none")


def test_tuning_tries_no_probes_that_hold_too_few(spark, tmp_dir, monkeypatch):
    """Each try searches all cells that it probes; those whose cells hold too few true neighbours can't reach the target."""
    vectors = frame(spark, np.random.default_rng(3).normal(size=(1200, 16)).astype(np.float32))
    index = pq.write_index(vectors, f"{tmp_dir}/pq", 10)
    cells, held = index.cells.count(), pq.ivf_hold_out(vectors)[1]
    # A cell of few rows is one file and one row of codes, however many cells there are.
    assert len(index.vectors.inputFiles()) == len(index.codes.inputFiles()) == index.codes.count() <= cells
    tried, knn = [], pq.knn
    monkeypatch.setattr(pq, "knn", lambda index, queries, k, probes=None, kept=None: (tried.append(probes), knn(index, queries, k, probes, kept))[1])
    tuned = pq._tune(index, vectors, held, 10, cells)
    some, tried[:] = list(tried), []
    monkeypatch.setattr(pq, "_least_probes", lambda *_: 1)
    assert pq._tune(index, vectors, held, 10, cells) == tuned == (index.probes, index.kept, pytest.approx(tuned[2]))
    assert some[0] >= 8 and tried[-len(some):] == some and len(some) <= len(tried) - 3


@pytest.mark.parametrize("most", [1, 500, 1 << 20])
def test_candidates_are_cut_in_the_task(spark, tmp_dir, monkeypatch, most):
    """More than a thousand kept rows a query: Spark makes no limit of its own before the exchange, so the kernel does."""
    vectors = frame(spark, np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32))
    index = pq.write_index(vectors, f"{tmp_dir}/pq", 10, cells=30)
    queries = frame(spark, np.random.default_rng(6).normal(size=(9, 8)).astype(np.float32), "query_id")
    best = lambda kept: {(r.query_id, r.doc_id) for r in pq.candidates(index, queries, 30, kept).collect()}
    rows = [(r.query_id, -r.score, r.doc_id) for r in pq.candidates(index, queries, 30, 600).collect()]
    assert len(rows) == 9 * 600
    monkeypatch.setattr(pq, "HELD_ROWS", most)
    want = {(q, d) for q in range(9) for _, _, d in sorted(r for r in rows if r[0] == q)[:50]}
    assert best(50) == want and len(best(600)) == 9 * 600


def test_rows_of_a_query_that_others_surpass_go():
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("query_id", "doc_id", "cell", "score"), r)) for r in rows])
    held = [batch((1, "a", 0, 1.0), (2, "a", 0, -5.0), (1, "b", 0, 3.0)), batch((1, "c", 1, 2.0), (1, "d", 1, 2.0), (1, "e", 1, float("nan")))]
    kept = pq._best_rows(held, 3).to_pydict()
    assert list(zip(kept["query_id"], kept["doc_id"])) == [(2, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "e")]  # ties stay
