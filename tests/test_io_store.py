"""File sources, store mutations and enrichment (file-based unit cases)."""

import json
import os
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loopdex.operators import enrich as en
from loopdex.operators import store as st
from loopdex.operators import worklist as wl
from loopdex.sources import blobs, captions, descriptions, manifests


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_captions_raw_vs_strip(spark, tmp_dir):
    p = f"{tmp_dir}/c.tsv"
    write(p, "u1\tcap one\nbadline\nu2\t\nu3\ta\tb\n  u4\tpadded  \n")
    lines = captions.read_lines(spark, p)
    raw = captions.parse_captions(lines, "raw").where("valid").orderBy("line_no").collect()
    assert [(r.url, r.description) for r in raw] == [("u1", "cap one"), ("u2", ""), ("u3", "a\tb"), ("  u4", "padded  ")]
    strip = captions.parse_captions(lines, "strip").where("valid").orderBy("line_no").collect()
    assert [(r.url, r.description) for r in strip] == [("u1", "cap one"), ("u3", "a\tb"), ("u4", "padded")]
    assert captions.batch_rounded_limit(captions.parse_captions(lines), 3, 2).count() == 4
    assert captions.head_limit(captions.parse_captions(lines), 2).count() == 2


def test_descriptions_quarantine_and_done(spark, tmp_dir):
    p = f"{tmp_dir}/d.jsonl"
    recs = ['{"url":"u1","mood":"m","tags":["a"]}', "{broken", '{"url":"u2","mood":["x"]}', '{"url":"u3","tags":["a",1]}', "[1]",
            '{"id":"i4","url":"u4","action":["x","y"]}']
    write(p, "\n".join(recs) + "\n")
    parsed = descriptions.parse_descriptions(descriptions.read_jsonl(spark, p))
    good = descriptions.good(parsed).orderBy("line_no").collect()
    assert [r.url for r in good] == ["u1", "u4"] and good[1].action == "x, y"
    rej = [r.reject for r in descriptions.quarantine(parsed).orderBy("line_no").collect()]
    assert rej == ["json", "type:mood", "type:tags", "not_object"]
    lines = descriptions.read_jsonl(spark, p)
    assert {r.url for r in descriptions.done_keys(lines, "url").collect()} == {"u1", "u2", "u3", "u4"}
    with pytest.raises(Exception):
        descriptions.done_keys(lines, "url", strict=True).collect()


def test_manifests(spark, tmp_dir):
    root = f"{tmp_dir}/sources"
    item = lambda i, **kw: dict(id=f"{i}", original_url=f"http://x/{i}.gif", local_file=f"{i}.gif", **kw)
    write(f"{root}/b_src/manifest.json", json.dumps({"source": "b", "items": [item(1, downloaded=True), item(2, downloaded=True, described=True), item(3)]}))
    write(f"{root}/a_src/manifest.json", json.dumps({"source": "a", "items": [item(4, downloaded=True, format="mp4")]}))
    write(f"{root}/_skip/manifest.json", json.dumps({"source": "z", "items": [item(9, downloaded=True)]}))
    items = manifests.manifest_items(manifests.read_manifests(spark, root))
    assert sorted(r.source_dir for r in items.select("source_dir").distinct().collect()) == ["a_src", "b_src"]
    assert manifests.read_manifests(spark, root, "a_src").count() == 1
    assert manifests.read_manifests(spark, f"{tmp_dir}/missing").count() == 0
    need = wl.pending_items(items, spark.createDataFrame([("a", "4"), ("a", "1")], "source string, id string"), 10).collect()
    assert sorted(r.id for r in need) == ["1"]
    marked = {r.id: r.described for r in wl.mark_described(items, spark.createDataFrame([("b", "1"), ("a", "2")], "source string, id string")).collect()}
    assert marked == {"1": True, "2": True, "3": None, "4": None}
    packed = wl.pack_manifests(wl.mark_described(items, spark.createDataFrame([("b", "1"), ("a", "2")], "source string, id string")))
    assert [i.id for i in packed.where("source = 'b'").first()["items"]] == ["1", "2", "3"]


def test_vector_blobs(spark, tmp_dir):
    d = f"{tmp_dir}/blobs"
    os.makedirs(d)
    with open(f"{d}/ok.bin", "wb") as f:
        f.write(struct.pack("<QQ", 1, 3) + struct.pack("<3f", 1.0, 2.0, 3.0))
    with open(f"{d}/empty.bin", "wb") as f:
        f.write(struct.pack("<QQ", 0, 3))
    with open(f"{d}/short.bin", "wb") as f:
        f.write(struct.pack("<QQ", 1, 3) + struct.pack("<1f", 1.0))
    got = {r.file: (r.status, r.embedding) for r in blobs.read_vector_blobs(spark, d).collect()}
    assert got["ok.bin"] == ("ok", [1.0, 2.0, 3.0]) and got["empty.bin"][0] == "empty" and got["short.bin"][0] == "short_data"


def test_upsert_idempotent_and_delete(spark, tmp_dir):
    store = spark.createDataFrame([("a", 1, "old"), ("b", 2, "keep")], "doc_id string, seq long, value string")
    up = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("c", 6, "z")], "doc_id string, seq long, value string")
    once = st.upsert(store, up)
    twice = st.upsert(once, up)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "value").collect()))
    assert rows(once) == rows(twice) == [("a", "y"), ("b", "keep"), ("c", "z")]
    assert rows(st.delete(once, spark.createDataFrame([("a",), ("zz",)], "doc_id string"))) == [("b", "keep"), ("c", "z")]
    target = f"{tmp_dir}/store"
    st.write_staged(once, target)
    st.write_staged(st.upsert(spark.read.parquet(target), up), target)
    assert rows(spark.read.parquet(target)) == rows(once)
    st.ensure_store(spark, "loopdex_t_store", "doc_id string, seq bigint", f"{tmp_dir}/tbl")
    st.ensure_store(spark, "loopdex_t_store", "doc_id string, seq bigint", f"{tmp_dir}/tbl")  # exists -> ok
    assert st.output_mode("captions", resume=True) == "append" and st.output_mode("manifest", any_existing=True, force=True) == "overwrite"


def test_describe_retry_and_status(spark):
    calls = []

    def describer(pdf: pd.DataFrame) -> pd.Series:
        calls.append(len(pdf))
        return pdf["payload"]

    items = spark.createDataFrame([(1, '{"literal":"x"}', False), (2, "not json", False), (3, "{}", False), (4, "{}", True)],
                                  "doc_id long, payload string, skip boolean").coalesce(1)
    d = en.parse_response(en.describe(items, describer, retries=1)).withColumn("removed", F.col("skip"))
    got = {r.doc_id: (r.attempts, r.status) for r in d.withColumn("status", en.status()).collect()}
    assert got == {1: (1, "ok"), 2: (2, "failed"), 3: (1, "failed"), 4: (0, "removed")}


def test_describe_isolates_failures(spark):
    def describer(pdf: pd.DataFrame) -> pd.Series:
        if (pdf["payload"] == "boom").any():
            raise RuntimeError("model down")
        return pdf["payload"]

    items = spark.createDataFrame([(1, '{"literal":"x"}'), (2, "boom"), (3, '{"literal":"y"}')], "doc_id long, payload string").coalesce(1)
    d = en.parse_response(en.describe(items, describer)).withColumn("removed", F.lit(False))
    assert {r.doc_id: r.status for r in d.withColumn("status", en.status()).collect()} == {1: "ok", 2: "failed", 3: "ok"}


def test_line_order_over_files(spark, tmp_dir):
    from loopdex.sources.captions import read_lines

    write(f"{tmp_dir}/in/a.txt", "a0\na1\n")
    write(f"{tmp_dir}/in/b.txt", "\n".join(f"b{i}" for i in range(3000)))
    got = [r.line for r in read_lines(spark, f"{tmp_dir}/in").orderBy("line_no").collect()]
    assert got == ["a0", "a1", *(f"b{i}" for i in range(3000))]


def test_stream_ingest_runs_and_failed_read(spark, tmp_dir, monkeypatch):
    import pytest

    from loopdex.operators import bucket_store
    from loopdex.operators.bucket_store import read_store
    from loopdex.streaming import ingest

    store = f"{tmp_dir}/store"
    line = lambda i, x: json.dumps({"id": i, "url": f"http://x/{i}.gif", "literal": x}) + "\n"
    write(f"{tmp_dir}/in/a.jsonl", line("1", "old") + line("2", "keep") + line("1", "new"))
    ingest.stream_ingest(spark, f"{tmp_dir}/in", store, f"{tmp_dir}/ck")
    write(f"{tmp_dir}/in/b.jsonl", line("2", "later") + line("3", "x"))
    ingest.stream_ingest(spark, f"{tmp_dir}/in", store, f"{tmp_dir}/ck")
    rows = lambda: sorted((r.doc_id, r.literal) for r in read_store(spark, store).collect())
    assert rows() == [("1", "new"), ("2", "later"), ("3", "x")]
    write(f"{tmp_dir}/in/c.jsonl", line("9", "z"))
    monkeypatch.setattr(bucket_store, "upsert", lambda *a: (_ for _ in ()).throw(OSError("read failed")))
    with pytest.raises(Exception, match="read failed"):
        ingest.stream_ingest(spark, f"{tmp_dir}/in", store, f"{tmp_dir}/ck")
    assert rows() == [("1", "new"), ("2", "later"), ("3", "x")]
