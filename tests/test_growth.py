"""Steps whose tasks must not grow with the input: spreading, parsing, packed vectors, shared postings."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from loopdex.operators import inverted as ix
from loopdex.operators.search_store import write_store
from loopdex.operators.util import spread
from loopdex.operators.vectors import hash_embed_sparse
from loopdex.sources.descriptions import good, parse_descriptions


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows_a_task(df) -> list[int]:
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_spread_of_a_scan_with_its_rows_in_one_task(spark):
    """As many tasks as cores, all rows in one of them: what a file of one row group gives."""
    rows = spark.range(0, 16000, 1, 4).where("id < 4000")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert max(rows_a_task(spread(rows, "id"))) < 2000
    assert max(rows_a_task(spread(rows, "id", 100))) < 300


def test_parse_comes_once_and_after_the_exchange(spark):
    lines = spark.createDataFrame([(1, '{"id":"a","action":["x","y"],"tags":["t"]}'), (2, "{broken"), (2, "[1]"), (None, '{"url":3}'), (3, None)], "line_no long, line string")
    parsed = parse_descriptions(lines)
    got = {(r["line_no"], r["reject"], r["id"], r["action"]) for r in parsed.collect()}
    assert got == {(1, None, "a", "x, y"), (2, "json", None, ""), (2, "not_object", None, ""), (None, "type:url", None, ""), (3, "json", None, "")}
    text = plan(good(parsed))
    assert len(re.findall("try_parse_json|parse_json", text.split("== Physical Plan ==")[-1])) <= 3
    tree = [n.split(")")[1].strip() for n in re.findall(r"^\(\d+\) .*$", text, re.M)]
    assert tree.index("Exchange") < min(i for i, n in enumerate(tree) if n.startswith("Generate"))


def test_sparse_embedding_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr("loopdex.operators.vectors.EMBED_ROWS", 2)
    docs = spark.createDataFrame([(1, "a a"), (1, "a"), (None, "b"), (None, "b"), (2, None)] + [(i, "w") for i in range(3, 40)], "doc_id long, text string")
    e = hash_embed_sparse(docs, "doc_id", "text")
    assert {(r["doc_id"], r["weight"]) for r in e.collect()} == {(1, 1.0), (None, 1.0)} | {(i, 1.0) for i in range(3, 40)}
    assert e.rdd.getNumPartitions() >= 21


@pytest.mark.parametrize("kind", ["float", "double"])
def test_stored_vectors_are_rows_of_their_own(spark, tmp_dir, kind):
    """A reader holds thousands of rows at once, so a row must not be a whole range of vectors."""
    docs = spark.range(0, 50).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.col("id").alias("seq"), F.lit("text").alias("combined_text"))
    vectors = docs.select("doc_id", F.expr(f"cast(array(seq, 1) as array<{kind}>)").alias("embedding"))
    store = write_store(docs, f"{tmp_dir}/store", vectors)
    assert store.vectors.count() == 50
    from loopdex.operators.search_store import nearest
    from loopdex.operators.tag_bitmaps import Masks

    of = spark.createDataFrame([(7, "all")], "query_id long, filter string")
    bits = store.tags.every.select(F.lit("all").alias("filter"), "range", F.col("bits").alias("mask"))
    asked = spark.createDataFrame([(7, [1.0, 0.0])], f"query_id long, embedding array<{kind}>")
    got = nearest(store, asked, 3, Masks(of, bits)).orderBy("vrank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("d49", 49.0), ("d48", 48.0), ("d47", 47.0)]


def test_postings_of_a_range_are_dealt_once_for_all_clauses(spark, tmp_dir):
    docs = spark.createDataFrame([(i, "red blue ring" if i % 2 else "blue red ring") for i in range(40)], "doc_id long, text string")
    index = ix.write_index(docs, f"{tmp_dir}/index")
    clauses = spark.createDataFrame([(q, 0, t) for q in range(300) for t in ("red blue",)], "query_id long, clause_id int, text string")
    terms = ix.query_terms(index, clauses)
    ranges = ix.range_bounds(index, terms).select("query_id", "clause_id", "range")
    scored = ix.score_ranges(index, terms, ranges, 2)
    assert scored.count() == 600 * ranges.select("range").distinct().count()
    assert "FlatMapCoGroups" in plan(scored)
    hits = ix.phrase_hits(index, clauses)
    assert "FlatMapCoGroups" in plan(hits)
    assert hits.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 20


def test_best_of_many_ranges_are_those_of_one(spark, tmp_dir):
    docs = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(0, id % 7), i -> concat('w', (id * 31 + i * i) % 40)), 'all')").alias("text"))
    clauses = spark.createDataFrame([(q, 0, f"w{q} w{q + 3} all") for q in range(30)], "query_id long, clause_id int, text string")
    some = [[tuple(r) for r in ix.match_top(ix.write_index(docs, f"{tmp_dir}/{n}", range_docs=n), clauses, 10).select("query_id", "rank", "doc_id", F.round("score", 6)).collect()] for n in (4, 4096)]
    assert sorted(some[0]) == sorted(some[1]) and len(some[0]) == len({(r[0], r[2]) for r in some[0]}) == 300


def test_hits_of_phrases_leave_a_range_as_its_best_only(spark, tmp_dir, monkeypatch):
    """Every document holds the phrases, so a row a hit would grow with queries times documents. What is kept must be what all
    candidates give: phrases, several of them, loose text beside them, masks, a phrase without tokens."""
    from loopdex.config import SearchConfig
    from loopdex.operators import search as S

    rows = [(f"d{i:03d}", i, "red ring " * (i % 3 + 1) + f"old bolt w{i % 7}" + " x" * (i % 5), ["hot"] if i % 4 else ["cold"]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, seq long, combined_text string, tags array<string>")
    cfg = SearchConfig(limit=6, blocked_tags=())
    store = write_store(docs, f"{tmp_dir}/store", cfg=cfg, range_docs=16)
    raw = ['"red ring"', '"red ring" "old bolt" w3', '"ring red" tag:cold', '"red ring" zzz', '"! !" "red ring"', '"red ring" -tag:hot w1 w2', "w5"]
    queries = spark.createDataFrame(list(enumerate(raw)), "query_id long, raw string")
    every = S.search(queries, store, cfg=cfg).text_candidates().collect()
    names = []
    monkeypatch.setattr(S, "written", lambda df, name, real=S.written: (names.append(name), real(df, name))[1])
    found = S.search(queries, store, cfg=cfg)
    got = {}
    for r in sorted(found.text_list.collect(), key=lambda r: r.trank):
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.tscore, 5)))
    want = {}
    for r in sorted(every, key=lambda r: (-round(r.tscore, 6), r.doc_id)):
        want.setdefault(r.query_id, []).append((r.doc_id, round(r.tscore, 5)))
    assert got == {q: x[: cfg.list_depth] for q, x in want.items()} and set(got) == {0, 1, 2, 5, 6}
    assert "phrase-candidates" not in names  # all hits, a row each, aren't made for the best
    kept = ix.conjunct_candidates(store.text, *found._with_phrases, 2, found.masks)
    assert max(r["count"] for r in kept.groupBy("query_id", "range").count().collect()) == 2


def _store_of_many_ranges(spark, path, cfg, n=240):
    docs = [(f"d{i * 7 % n:03d}", i * 5 % n, "red ring " * (i % 3 + 1) + f"old bolt w{i % 7} v{i % 11}" + " x" * (i % 5), [f"Tag w{i % 7}", f"v{i % 11}"]) for i in range(n)]
    docs = spark.createDataFrame(docs, "doc_id string, seq long, combined_text string, tags array<string>")
    vectors = docs.select("doc_id", F.expr("transform(sequence(1, 4), i -> cast(sin(seq * i + i) as float))").alias("embedding"))
    return docs, write_store(docs, path, vectors, cfg=cfg, range_docs=4)


def _queries(spark, n):
    forms = ["w{a} v{b}", '"red ring" "old bolt" v{b} -tag:v{b}', '"bolt w{a}" tag:"tag w{a}"', "tag:v{b} -tag:w{a}", "x tag:v{a} -tag:v{b}", '"! !" w{a}', "", "zzz tag:v{a}"]
    rows = [(i, forms[i % len(forms)].format(a=i % 7, b=i % 11)) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, raw string"), [(i, [float((i * 3 + j * j) % 5 - 2) for j in range(4)]) for i in range(0, n, 3)]


@pytest.mark.parametrize("group", [3, 16384])
def test_lists_of_groups_are_those_of_all_candidates(spark, tmp_dir, monkeypatch, group):
    """However queries and ranges are dealt: the text lists are the best of all candidates, the vector lists those of a loop over
    all pairs, the first documents those that the masks leave in store order."""
    import numpy as np

    from loopdex.config import SearchConfig
    from loopdex.operators import lists
    from loopdex.operators import search as S
    from loopdex.operators import tag_bitmaps as tb

    monkeypatch.setattr(lists, "ASKS_A_TASK", group)
    cfg = SearchConfig(limit=6, blocked_tags=("v3",))
    docs, store = _store_of_many_ranges(spark, f"{tmp_dir}/store", cfg)
    queries, qv = _queries(spark, 80)
    found = S.search(queries, store, None, spark.createDataFrame(qv, "query_id long, embedding array<double>"), cfg)
    want = {}
    for r in sorted(found.text_candidates().collect(), key=lambda r: (-round(r.tscore, 6), r.doc_id)):
        want.setdefault(r.query_id, []).append((r.doc_id, round(r.tscore, 5)))
    got = {}
    for r in sorted(found.text_list.collect(), key=lambda r: r.trank):
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.tscore, 5)))
    assert got == {q: x[:6] for q, x in want.items()} and len(got) > 20
    allowed = {}
    for r in tb.places(found.masks.of.join(found.masks.bits, "filter").select("query_id", "range", "mask")).join(store.text.docs, ["range", "local"]).collect():
        allowed.setdefault(r.query_id, []).append((r.seq, r.doc_id))
    first = {}
    for r in sorted(found._first().collect(), key=lambda r: r.seq):
        first.setdefault(r.query_id, []).append((r.seq, r.doc_id))
    plain = [r.query_id for r in found.pq.where("mode IN ('tags', 'all')").collect()]
    assert first == {q: sorted(allowed[q])[:6] for q in plain if q in allowed} and len(first) > 10
    vector = {r.doc_id: np.array(r.embedding, np.float64) for r in store.vectors.join(store.text.docs, ["range", "local"]).collect()}
    near = {}
    for r in sorted(found.vector_list.collect(), key=lambda r: r.vrank):
        near.setdefault(r.query_id, []).append(r.doc_id)
    loose = {r.query_id for r in found.pq.where("use_vector").collect()}
    asked = {q: np.array(x) for q, x in qv if q in loose and q in allowed}
    assert near == {q: sorted((d for _, d in allowed[q]), key=lambda d: (-round(float(vector[d] @ x), 6), d))[:6] for q, x in asked.items()} and len(near) > 10


def test_hits_write_no_row_a_query_and_range(spark, tmp_dir, monkeypatch):
    """Masks, bounds and asked ranges were written a row a query (or filter) and range; only the best of a query may be."""
    from loopdex.config import SearchConfig
    from loopdex.operators import lists, tag_bitmaps
    from loopdex.operators import search as S

    cfg, n = SearchConfig(limit=2, blocked_tags=()), 150
    docs, store = _store_of_many_ranges(spark, f"{tmp_dir}/store", cfg)
    ranges = store.orders.count()
    queries, qv = _queries(spark, n)
    rows = []
    for module in (S, lists, tag_bitmaps, ix):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: (out := real(df, name), rows.append((out.count(), name)))[0])
    hits = S.search(queries, store, None, spark.createDataFrame(qv, "query_id long, embedding array<double>"), cfg).hits
    assert hits.select("query_id").distinct().count() > n // 2
    assert ranges >= 60 and max(rows)[0] <= 2 * 2 * n < n * ranges // 4, rows


def test_hits_of_queries_that_say_the_same_or_share_an_id(spark, tmp_dir, monkeypatch):
    from loopdex.config import SearchConfig
    from loopdex.operators import search as S

    monkeypatch.setattr(S, "QUERIES_A_DEAL", 2)
    cfg = SearchConfig(limit=4, blocked_tags=())
    docs, store = _store_of_many_ranges(spark, f"{tmp_dir}/store", cfg, 60)
    raw = [(1, "w1 v2"), (2, "v2  W1"), (3, "v2 w1"), (4, "w1 tag:v2"), (5, ""), (6, "  "), (7, '"red ring"'), (7, '"red ring"'), (8, "w1"), (8, "tag:v2"), (None, "w1"), (9, None), (10, "w1 v2")]
    queries = spark.createDataFrame(raw, "query_id long, raw string")
    vectors = spark.createDataFrame([(3, [1.0, 0.0, 0.0, 0.5]), (8, [0.0, 1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    every = lambda q: {i: sorted((r["rank"], r.doc_id, round(r.list_score, 6)) for r in q if r.query_id == i) for i in {r.query_id for r in q}}
    hits = every(S.search(queries, store, None, vectors, cfg).hits.collect())
    assert hits[1] == hits[2] == hits[10] and len(hits[1]) == 4 and hits[3] != hits[1] and hits[5] == hits[6] == hits[9] and None not in hits
    for i, text in ((3, "v2 w1"), (4, "w1 tag:v2")):
        alone = S.search(spark.createDataFrame([(i, text)], "query_id long, raw string"), store, None, vectors, cfg).hits.collect()
        assert every(alone) == {i: hits[i]}
    assert len(hits[8]) == 4
