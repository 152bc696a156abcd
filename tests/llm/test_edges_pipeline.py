"""Edge rows of the native operators, and the pipeline's stages against plain Python versions."""

from __future__ import annotations

import struct
from collections import Counter

import corpus_pipeline as P
from loopdex.llm import mixing, plans, quality_rules, url_filter
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_quality_rules_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b a b a b"), (4, "w " * 5000), (4, "w " * 5000), (None, "x\nx\n \nx #")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, n_words string")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judge(df).collect()]
    want = [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 6, 6, 0, 0, 6), (4, 5000, 5000, 0, 0, 5000), (4, 5000, 5000, 0, 0, 5000), (None, 4, 4, 1, 1, 0)]
    assert Counter(got) == Counter((*w, True, False) for w in want)
    assert quality_rules.judge(df.limit(0)).collect() == []


def test_url_filter_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.net/x?q#f"), (4, "https://example.net/en/a"), (5, "http://www.example.com/de/"), (6, "http://example.com:80/de"),
            (7, "http://x.org/fr/"), (8, "http://q.io/p/"), (9, "https://www.Q.io/p#z"), (9, "https://www.Q.io/p#z"), (10, "http://badexample.com/de/"), (11, "http://a.net")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id bigint, url string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.repeated(df)).collect())
    assert got == Counter([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.net", "/x", "net/", "block"), (4, "example.net", "/en/a", "example.net/en/", "allow"),
        (5, "www.example.com", "/de/", "example.com/de/", "block"), (6, "example.com:80", "/de", None, "block"), (7, "x.org", "/fr/", "org/fr/", "allow"),
        (8, "q.io", "/p/", None, "block"), (9, "www.q.io", "/p", None, "block"), (9, "www.q.io", "/p", None, "block"),
        (10, "badexample.com", "/de/", None, "allow"), (11, "a.net", "", None, "allow")])
    assert url_filter.judge(df.limit(0), url_filter.repeated(df.limit(0))).collect() == []


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3] if i % 5 else None) for i in range(200)] + [(900, None, "a"), (901, "x " * 3000, "hot"), (None, "y y", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, size int")
    copies = mixing.schedule(mixing.sized(df))
    got = mixing.taken_by_document(copies).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == round(sum({r.source: r.target for r in got}.values()))
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) and mine[0].target <= 2 * mine[0].source_size
    assert Counter(map(tuple, mixing.taken_by_document(mixing.schedule(mixing.sized(df))).collect())) == Counter(map(tuple, got))
    finish = [r.finish for r in mixing.ordered(copies).collect()]
    assert finish == sorted(finish)
    assert mixing.schedule(mixing.sized(df.limit(0))).collect() == [] and len(mixing.schedule(mixing.sized(df.where("doc_id = 900"))).collect()) == 2


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = P.quality(spark, docs, SMALL)
    judged = {r.doc_id for r in plans.op1_quality_rules(spark, SMALL).where("kept").collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == judged and kept.columns == P.COLUMNS
    one = P.near_duplicates(spark, kept, SMALL)
    want = {i for i, (_, c) in brute.near_duplicates([(r.doc_id, r.text) for r in rows], 5, 80).items() if i == c}
    assert {r.doc_id for r in one.collect()} == want and one.count() == len(want)
    mixed = P.mix(spark, one, SMALL)
    taken = {r.doc_id: r.taken for r in mixing.taken_by_document(mixing.schedule(mixing.sized(one))).where("taken > 0").collect()}
    words: Counter = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(brute.words(r.text))
    assert dict(words) == taken and mixed.columns == P.COLUMNS
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=plans.tokenizer_path(plans.PIECES))
    texts = Counter((r.doc_id, r.text) for r in mixed.collect())
    got = Counter((r.doc_id, r.ids) for r in P.run(spark, SMALL).collect())
    assert got == Counter({(i, (lambda x: struct.pack(f"<{len(x)}I", *x))(other.encode(t))): n for (i, t), n in texts.items()})
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).collect() == []
