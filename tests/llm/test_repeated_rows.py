"""Rows that repeat an id, equal or not, in mixing and in nearest neighbours; vectors in double precision."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import numpy as np

from loopdex.llm import learned_partitions, mixing


def test_mixing_keeps_every_row(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (1, "a b", "s"), (2, "x " * 40, "t"), (None, "n n n", "s"), (None, "n n n", "s"), (3, None, "t"), (3, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.size, r.taken) for r in mixing.taken_by_document(mixing.schedule(mixing.sized(df))).collect())
    assert sum(got.values()) == len(rows)
    assert all(0 <= taken <= 2 * size for _, size, taken in got)
    assert Counter({(i, s): 0 for i, s, _ in got} | {}) .keys() == Counter((i, len((t or "").split())) for i, t, _ in rows).keys()
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = Counter((r[0], r[1], r[4]) for r in con.execute(mixing.sql()).fetchall())
    assert got == want


def by_hand(rows, k):
    """{(query id, vector): [(vec_id, distance)]} of rows (vec_id, vector) divisible by 100."""
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(w, np.float64) - np.array(v, np.float64)) ** 2).sum())), j) for j, w in rows if j != i)
            out[(i, tuple(v))] = [(j, x) for x, j in d[:k]]
    return out


def test_neighbours_of_repeated_queries(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=4).tolist()) for i in range(1, 300)]
    rows += [(0, [0.5, 0.5, 0.5, 0.5]), (0, [0.5, 0.5, 0.5, 0.5]), (0, [-1.0, 2.0, 0.0, 1.0]), (77, rows[10][1])]
    got = defaultdict(list)
    for x in learned_partitions.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    want = defaultdict(list)
    for (i, _), near in by_hand(rows, 5).items():
        want[i] += [(n, j, d) for n, (j, d) in enumerate(near, 1)]
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert len(got[0]) == 10 and len(got[100]) == 5


def test_double_vectors_keep_their_precision(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**30 + 1, 1.0]), (2, [2.0**30 + 3, 1.0])]
    got = learned_partitions.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    assert sorted((x["rank"], x.vec_id, x.score) for x in got) == [(1, 1, 1.0), (2, 2, 3.0)]
