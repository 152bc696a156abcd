"""The written index, tag bitmaps, packed kNN, the embedder and search on a written store, against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopdex.config import SearchConfig
from loopdex.operators import inverted as ix
from loopdex.operators import knn
from loopdex.operators import search as S
from loopdex.operators import tag_bitmaps as tb
from loopdex.operators.embedder import Embedder, HashEmbedder, embed, embedded
from loopdex.operators.search_store import read_store, write_store

WORDS = [f"w{i}" for i in range(40)]


def tok(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


def corpus(n=600, seed=1):
    """Texts of Zipf words, some equal, one of a single long token, some empty or null."""
    r = np.random.default_rng(seed)
    p = 1 / np.arange(1, 41)
    texts = [" ".join(r.choice(WORDS, r.integers(1, 60), p=p / p.sum())) for _ in range(n)]
    texts[5], texts[6], texts[7] = "", None, "x" * 30_000
    for i in range(100, 140):
        texts[i] = texts[99]
    return [(i * 3 % 1000, t) for i, t in enumerate(texts)]


class Brute:
    def __init__(self, rows, k1=1.2, b=0.75):
        self.toks = {i: tok(t) for i, t in rows}
        self.n, self.avg, self.k1, self.b = len(rows), sum(map(len, self.toks.values())) / len(rows), k1, b
        self.df = Counter(t for x in self.toks.values() for t in set(x))

    def idf(self, t):
        return math.log(1 + (self.n - self.df[t] + 0.5) / (self.df[t] + 0.5))

    def norm(self, tf, dl):
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avg))

    def match(self, text):
        out = {}
        for i, x in self.toks.items():
            c = Counter(x)
            s = [self.idf(t) * self.norm(c[t], len(x)) for t in set(tok(text)) if c[t]]
            if s:
                out[i] = sum(s)
        return out

    def phrase(self, text):
        p, out = tok(text), {}
        for i, x in self.toks.items():
            tf = sum(x[j : j + len(p)] == p for j in range(len(x) - len(p) + 1)) if p else 0
            if tf:
                out[i] = (tf, sum(self.idf(t) for t in set(p)) * self.norm(tf, len(x)))
        return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, ix.write_index(df, str(tmp_path_factory.mktemp("index")), range_docs=50, buckets=4)


QUERIES = ["w1 w30 w39", "w0", "W20 w21, w22 w23", "nothing here", "w39 w39", "", "x" * 30_000]


def clauses(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "query_id long, clause_id int, text string")


def test_stats_and_terms(index):
    rows, i = index
    b = Brute(rows)
    assert i.n_docs == len(rows) and i.avgdl == pytest.approx(b.avg)
    cf = Counter(t for x in b.toks.values() for t in x)
    assert {(r.token, r.df, r.cf) for r in ix.token_stats(i).collect()} == {(t, b.df[t], cf[t]) for t in cf}
    assert i.blocks.agg(F.max(F.size("docs"))).first()[0] <= 50  # a token of every range is many small blocks


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_match_top(spark, index, k):
    rows, i = index
    b = Brute(rows)
    got = defaultdict(list)
    for r in sorted(ix.match_top(i, clauses(spark, QUERIES), k).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.doc_id, round(r.score, 6)))
    for q, text in enumerate(QUERIES):
        want = sorted(((-round(s, 6), d) for d, s in b.match(text).items()))[:k]
        assert got.get(q, []) == [(d, -s) for s, d in want], text


def test_match_reads_fewer_blocks(spark, index, tmp_dir):
    """A rare term's ranges decide the head, so blocks of a common term elsewhere aren't read; nor is the result changed."""
    _, i = index
    read = {r.query_id: (r.stored, r.read) for r in ix.blocks_read(i, clauses(spark, QUERIES), 3).collect()}
    assert all(a >= b for a, b in read.values()) and sum(b for _, b in read.values()) < sum(a for a, _ in read.values())
    rows = [(n, "the " * (n % 7 + 1) + ("gold" if n % 199 == 3 else f"u{n}")) for n in range(800)]
    rare = ix.write_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), f"{tmp_dir}/rare", range_docs=20, buckets=3)
    asked = clauses(spark, ["the gold"])
    stored, seen = ix.blocks_read(rare, asked, 4).select("stored", "read").first()
    assert seen < 0.4 * stored
    want = sorted((-round(s, 6), d) for d, s in Brute(rows).match("the gold").items())[:4]
    assert [(-round(r.score, 6), r.doc_id) for r in sorted(ix.match_top(rare, asked, 4).collect(), key=lambda r: r["rank"])] == want


def test_phrases(spark, index):
    rows, i = index
    b = Brute(rows)
    texts = ["w0 w1", "w0 w0", "w0 w0 w0", "w1 w0 w1", "w39", "w0 gone", "!!", "x" * 30_000, rows[99][1], rows[99][1] + " w0"]
    hits = ix.phrase_hits(i, clauses(spark, texts)).join(i.docs, ["range", "local"]).collect()
    got = {(r.query_id, r.doc_id): (r.tf, round(r.score, 6)) for r in hits}
    assert got == {(q, d): (tf, round(s, 6)) for q, t in enumerate(texts) for d, (tf, s) in b.phrase(t).items()}
    assert any(tf > 1 for tf, _ in got.values()) and len(hits) == len(got)


def test_counts(spark, index):
    rows, i = index
    b = Brute(rows)
    some = i.docs.where("doc_id < 300").select(F.lit(0).cast("long").alias("query_id"), "range", "local")
    got = {r.query_id: r.n for r in ix.count_matches(i, clauses(spark, QUERIES), None, some).collect()}
    assert got == {q: n for q, t in enumerate(QUERIES) if (n := sum(q > 0 or d >= 300 for d in b.match(t)))}


def test_index_edges(spark, tmp_dir):
    empty = spark.createDataFrame([], "doc_id long, text string")
    i = ix.write_index(empty, f"{tmp_dir}/empty")
    assert i.n_docs == 0 and ix.match_top(i, clauses(spark, ["a"]), 3).collect() == [] and ix.phrase_hits(i, clauses(spark, ["a b"])).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    i = ix.write_index(rows, f"{tmp_dir}/small")
    assert [r.doc_id for r in ix.match_top(i, clauses(spark, ["a"]), 3).collect()] == [1] and i.n_docs == 2
    with pytest.raises(ValueError, match="written for"):
        ix.read_index(spark, f"{tmp_dir}/small", SearchConfig(k1=2.0))


# -- tags -------------------------------------------------------------------------------------------------------------


def holds(doc_tags, clause):
    return bool(clause) and any(f" {' '.join(clause)} " in f" {' '.join(t)} " for t in doc_tags)


def test_masks(spark, tmp_dir):
    r = np.random.default_rng(3)
    tags = [["live", "leak"], ["live"], ["cat"], ["cat", "live", "leak"], ["a", "b", "a"], []]
    docs = [(int(i // 70), int(i % 70), [tags[k] for k in r.choice(6, r.integers(0, 4))]) for i in range(400)]
    t = tb.write_tags(spark.createDataFrame(docs, "range long, local int, tag_toks array<array<string>>"), f"{tmp_dir}/tags")
    asked = [([], []), ([["live"]], []), ([["live", "leak"]], [["cat"]]), ([["cat"], ["a", "b"]], []), ([], [["live"], []]), ([[]], []), ([["gone"]], []), ([["b", "a"]], [["x"]]), ([["live"]], [])]
    queries = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "query_id long, req array<array<string>>, neg array<array<string>>")
    f, of = tb.filters(queries)
    assert f.count() == 8
    for blocked, names in ((None, []), (F.array(F.array(F.lit("cat"))), [["cat"]])):
        bits = tb.masks(t, f, blocked)
        got = {(x.query_id, x.range, x.local) for x in tb.places(bits).join(of, "filter").collect()}
        assert got == {(i, a, b) for i, (req, neg) in enumerate(asked) for a, b, d in docs if all(holds(d, c) for c in req) and not any(holds(d, c) for c in neg + names)}
        assert bits.where(F.length("mask") == 0).count() == 0


def test_browse_reads_in_store_order(spark):
    r = np.random.default_rng(5)
    seqs = r.permutation(1000).reshape(20, 50)
    seqs[np.argsort(seqs.min(1))] = np.sort(seqs.ravel()).reshape(20, 50)  # ranges follow the store order, mostly
    seqs[3, 0], seqs[17, 4] = seqs[17, 4], seqs[3, 0]
    orders = spark.createDataFrame([(i, int(s.min()), [int(x) for x in s]) for i, s in enumerate(seqs)], "range long, first long, seqs array<long>")
    allowed = {(f, i): r.random(50) < p for f, p in (("all", 1.0), ("few", 0.02)) for i in range(20)}
    rows = [(f, i, bytearray(np.packbits(m, bitorder="little").tobytes())) for (f, i), m in allowed.items() if m.any()]
    got = tb.browse(orders, spark.createDataFrame(rows, "filter string, range long, mask binary"), 7).collect()
    for f in ("all", "few"):
        want = sorted(int(seqs[i][j]) for (g, i), m in allowed.items() if g == f for j in np.flatnonzero(m))[:7]
        assert sorted(x.seq for x in got if x.filter == f)[:7] == want
    assert len({x.range for x in got if x.filter == "all"}) <= 4


# -- vectors ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1 << 20, 8])  # broadcast, and dealt blocks beyond the bound
def test_knn_exact(spark, monkeypatch, most):
    monkeypatch.setattr(knn, "MAX_BROADCAST_BYTES", most)
    monkeypatch.setattr(knn, "QUERIES_A_BLOCK", 3)
    r = np.random.default_rng(3)
    v, q = r.integers(-3, 4, (300, 8)).astype(np.float64), r.integers(-3, 4, (7, 8)).astype(np.float64)
    vectors = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)] + [("other", [1.0]), ("none", None)], "doc_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(50, None), (51, [1.0, 2.0])], "query_id long, embedding array<double>")
    got = defaultdict(list)
    for x in sorted(knn.knn_exact(vectors, queries, 5).collect(), key=lambda x: x.vrank):
        got[x.query_id].append((x.doc_id, x.score))
    want = {i: [(d, s) for s, d in sorted((-s, str(j)) for j, s in enumerate(v @ x))[:5]] for i, x in enumerate(q)}
    assert got == {i: [(d, -s) for d, s in w] for i, w in want.items()}
    assert knn.knn_exact(vectors.limit(0), queries, 5).collect() == [] and knn.knn_exact(vectors, queries.limit(0), 5).collect() == []


# -- embedder ---------------------------------------------------------------------------------------------------------


class Picky(Embedder):
    """Fails on some texts, and leaves a file each time that it is loaded."""

    dim = 2

    def __init__(self, folder, mood="fine"):
        self.folder, self.mood = folder, mood

    def load(self):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        if self.mood == "broken":
            raise OSError("no model")

        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("bad text")
            return [[len(t), float("nan") if "nan" in t else 1.0] for t in texts]

        return run


def test_embedder_isolates_failures(spark, tmp_path):
    rows = [(i, "bad" if i % 50 == 7 else "nan" if i == 20 else None if i == 30 else "t" * (i % 9)) for i in range(900)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, embedding string").repartition(6)
    got = {r.doc_id: (r.embedding, r.embed_error) for r in embed(df, "text", Picky(str(tmp_path))).collect()}
    for i, t in rows:
        vector, error = got[i]
        if t in ("bad", "nan"):
            assert vector is None and ("bad text" in error or "not finite" in error)
        else:
            assert vector == [len(t or ""), 1.0] and error is None
    good, failed = embedded(df, "text", Picky(str(tmp_path)))
    assert good.count() == 900 - failed.count() and failed.count() == 19 and "embed_error" not in good.columns


def test_embedder_loads_once_a_worker(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(16)
    one = Picky(str(tmp_path))
    for _ in range(3):
        assert embed(df, "text", one).where("embed_error IS NULL").count() == 4000
    assert 1 <= len(list(tmp_path.iterdir())) <= 8  # 48 tasks on 4 cores; a worker that is reused loads nothing


def test_embedder_that_cannot_load(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert {r.embed_error for r in embed(df, "text", Picky(str(tmp_path), "broken")).collect()} == {"OSError: no model"}


def test_hash_embedder(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: np.asarray(r.embedding) for r in embed(df, "text", HashEmbedder(dim=32)).collect()}
    assert rows[1].shape == (32,) and np.linalg.norm(rows[1]) == pytest.approx(1.0, rel=1e-6)
    assert not rows[2].any() and not rows[3].any()


# -- search -----------------------------------------------------------------------------------------------------------


def test_search_reads_no_corpus(spark, tmp_dir):
    """After the store is written, the plans of hits and totals scan neither the documents nor tokenise a text of theirs."""
    docs = spark.createDataFrame([(f"d{i}", i, f"red cat number {i}", ["Cat", f"n{i % 3}"]) for i in range(40)], "doc_id string, seq long, combined_text string, tags array<string>")
    docs.write.parquet(f"{tmp_dir}/docs")
    cfg = SearchConfig(limit=5)
    write_store(spark.read.parquet(f"{tmp_dir}/docs"), f"{tmp_dir}/store", embedder=HashEmbedder(), cfg=cfg, range_docs=8)
    queries = spark.createDataFrame([(1, "red 7"), (2, "tag:n1 -tag:cat"), (3, ""), (4, '"cat number" 3 tag:n0'), (5, "tag:n2")], "query_id long, raw string")
    found = S.search(queries, read_store(spark, f"{tmp_dir}/store", cfg), cfg=cfg, embedder=HashEmbedder())
    hits = defaultdict(list)
    for r in sorted(found.hits.collect(), key=lambda r: r["rank"]):
        hits[r.query_id].append(r.doc_id)
    assert hits[1][0] == "d7" and len(hits[1]) == 5 and 2 not in hits
    assert hits[3] == [f"d{i}" for i in range(5)] and hits[5] == [f"d{i}" for i in (2, 5, 8, 11, 14)]
    assert "d3" in hits[4] and all(int(d[1:]) % 3 == 0 for d in hits[4])
    assert {r.query_id: r.total for r in found.totals.collect()} == {1: 40, 2: 0, 3: 40, 4: 5, 5: 13}
    for plan in (found.hits, found.totals):
        text = plan._jdf.queryExecution().toString()
        assert f"{tmp_dir}/docs" not in text and "regexp_extract_all" not in text
