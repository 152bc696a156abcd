"""Torn and damaged files, several links a record, and joins that meet one hot key."""

from __future__ import annotations

import gzip

import numpy as np
import pytest

from loopdex.llm import plans, separators, url_filter, warc


def record(kind, name, body=b"", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"{k.replace('_', '-')}: {x}" for k, v in headers.items() for x in (v if isinstance(v, list) else [v])]]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_warc_links_and_damage(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    whole = b"".join([
        record("warcinfo", "<w>", b"software: x\r\n"),
        record("response", "<a>", http + b"one", Content_Type="application/http"),
        record("response", "<b>", http + b"two", Content_Type="application/http", WARC_Payload_Digest="sha1:" + "0" * 40),
        record("request", "<q>", b"GET /", WARC_Concurrent_To=["<a>", "<b>"]),
        record("metadata", "<m>", b"k: v\r\n", WARC_Concurrent_To="<q>"),
        record("metadata", "<n>", b"k: w\r\n", WARC_Concurrent_To=["<gone>", "<b>"]),
    ])
    cut = record("response", "<c>", http + b"three", Content_Type="application/http")
    (tmp_path / "part-0").write_bytes(gzip.compress(whole))
    (tmp_path / "part-1").write_bytes(cut[: cut.index(b"three") + 1])
    (tmp_path / "part-2").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <d>")
    rows = {r.record_id: r for r in warc.records(spark, str(tmp_path)).collect()}
    assert {k: r.damage for k, r in rows.items()} == {"<w>": None, "<a>": None, "<b>": "digest", "<q>": None, "<m>": None, "<n>": None, "<c>": "short", "<d>": "short"}
    assert rows["<c>"].payload_bytes == 1
    got = {r.capture_id: r for r in warc.assemble(warc.records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<a>", "<b>", "<c>", "<d>", "<gone>"}
    assert got["<a>"].metadata.record_id == "<m>" and got["<a>"].request.record_id == got["<b>"].request.record_id == "<q>"
    assert got["<b>"].metadata.record_id in ("<m>", "<n>") and got["<b>"].response.damage == "digest" and got["<c>"].response.damage == "short"
    assert got["<gone>"].response is None and got["<gone>"].metadata.record_id == "<n>"


def test_warc_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 2000, "clash", 5), (2, "http://b/", "x" * 2000, "clash", 6), (3, None, None, "", 7)], "page_id long, url string, html string, digest string, size int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.captured(pages).collect())
    assert got == [(1, 2000, "revisit", 2), (2, 2000, "response", None), (3, 0, "response", None)]


@pytest.mark.parametrize("block_bytes", [3, 5, 1 << 20])
def test_torn_files(spark, tmp_path, block_bytes):
    np.array([5, 9, 7, 9, 9, 4], "<u2").tofile(tmp_path / "a.ids")
    (tmp_path / "b.ids").write_bytes(np.array([1, 9], "<u2").tobytes() + b"x")
    (tmp_path / "c.ids").write_bytes(b"x")
    (tmp_path / "d.ids").write_bytes(b"")
    got = sorted((r.path[-5:], r.ordinal, r.start, r.n_tokens, r.ended, r.torn) for r in separators.scan(spark, str(tmp_path), 9, 2, block_bytes).collect())
    assert got == [("a.ids", 0, 0, 2, True, 0), ("a.ids", 1, 2, 2, True, 0), ("a.ids", 2, 4, 1, True, 0), ("a.ids", 3, 5, 1, False, 0), ("b.ids", 0, 0, 2, True, 1)]


def test_flat_widths_and_edges(spark, tmp_path):
    path = plans.tokenizer_path(plans.BYTE_BPE)
    assert separators.width_of(path, 50256) == 2 and separators.width_of(path, 70_000) == 4
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    with pytest.raises(ValueError, match="doesn't fit"):
        separators.write_flat(df, path, str(tmp_path / "x"), 70_000, 2)
    for separator in (50256, 70_000):
        got = sorted((r.doc_id or 0, r.n_tokens, r.ended) for r in separators.counted(df, path, separator).collect())
        assert got == [(0, 1, True), (1, 3, True), (1, 3, True), (2, 1, True)]
    clash = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n_tokens int, file string")
    assert [r.n_tokens for r in separators.counted(clash, path, 50256).collect()] == [3]
    assert separators.counted(df.limit(0), path, 50256).collect() == []


def test_one_listed_url_holds_most_rows(spark):
    rows = [(i, "http://hot.org/x" if i % 3 else f"http://u{i}.org/") for i in range(600)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "page_id long, url string, listed string, _at int, _block int")
    listed = spark.createDataFrame([("hot.org/x",), ("u3.org",)], "canonical string")
    got = {r.page_id: (r.listed, r.verdict) for r in url_filter.judge(df, listed).collect()}
    assert got == {i: (bool(i % 3) or i == 3, "block" if i % 3 or i == 3 else "allow") for i, _ in rows}
