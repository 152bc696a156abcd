"""Debounce / repeat suppression (batch = stream, skew-safe = plain islands) and sampling properties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loopdex.operators import sample as sp
from loopdex.streaming import debounce as db

T0 = dt.datetime(2024, 1, 1)


def ev(spark, rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(milliseconds=ms), x) for k, ms, x in rows], "k long, ts timestamp_ntz, x string")


def test_keystroke_cases(spark):
    rows = [(1, 0, "c"), (1, 100, "ca"), (1, 250, "cat"), (1, 5000, "   "), (1, 9000, "dog"), (1, 9300, "dogs"),  # exactly 300 ms merges
            (2, 0, "x")]
    out = db.debounce(ev(spark, rows), "k", "ts", "x", 300_000).orderBy("k", "emit_us").collect()
    assert [(r.k, r.x) for r in out] == [(1, "cat"), (1, "dogs"), (2, "x")]


def test_submit_emits_immediately(spark):
    df = spark.createDataFrame([(1, T0, "ca", "edit"), (1, T0 + dt.timedelta(milliseconds=50), "cat", "submit")],
                               "k long, ts timestamp_ntz, x string, kind string")
    out = db.debounce(df, "k", "ts", "x", 300_000, kind="kind").collect()
    assert sorted(r.x for r in out) == ["ca", "cat"]


def test_two_level_sessions_equal_plain_islands(spark):
    rnd = random.Random(5)
    rows, t = [], 0
    for _ in range(400):
        t += rnd.choice([10, 50, 200, 299, 300, 301, 1000, 5000])
        rows.append((rnd.choice([1, 1, 1, 2, 3]), t, rnd.choice(["a", "b", "c"])))
    df = ev(spark, rows)
    got = sorted(map(tuple, db.sessions(df, "k", "ts", "x", 300_000, bucket_us=700_000).select("k", "start_us", "last_us", "x", "n_events").collect()))
    exp = []
    for k in {r[0] for r in rows}:
        evs = sorted((ms * 1000, x) for kk, ms, x in rows if kk == k)
        cur = None
        for t_us, x in evs:
            if cur and t_us - cur[2] <= 300_000:
                cur = [cur[0], cur[1], t_us, x, cur[4] + 1]
            else:
                if cur:
                    exp.append(tuple(cur))
                cur = [k, t_us, t_us, x, 1]
        exp.append(tuple(cur))
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert got == sorted((k, s + base, l + base, x, n) for k, s, l, x, n in exp)


def test_drop_repeats(spark):
    rows = [(1, 0, "a"), (1, 10, "a"), (1, 20, "b"), (1, 30, ""), (1, 40, "b"), (1, 5_000_000, "b"), (2, 0, "a")]
    out = db.drop_repeats(ev(spark, rows), "k", "ts", "x", bucket_us=1_000_000_000).orderBy("k", "ts").collect()
    assert [(r.k, r.x) for r in out] == [(1, "a"), (1, "b"), (1, "b"), (2, "a")]


def test_stream_equals_batch_on_closed_sessions(spark, tmp_dir):
    rows = [(k, i * 97_000 + (i // 5) * 500_000, f"t{i % 7}") for k in (1, 2) for i in range(30)]  # sessions of 5 events
    df = ev(spark, rows)
    df.write.parquet(f"{tmp_dir}/ev")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/ev")
    agg = db.stream_debounce(s, "k", "ts", "x", "100 seconds", "0 seconds")
    q = agg.writeStream.outputMode("append").format("memory").queryName("t_stream_db").option(
        "checkpointLocation", f"{tmp_dir}/ck").start()
    q.processAllAvailable()
    q.stop()
    stream = {tuple(r) for r in spark.table("t_stream_db").select("k", "emit_us", "x").collect()}
    batch = {tuple(r) for r in db.debounce(df, "k", "ts", "x", 100_000_000).select("k", "emit_us", "x").collect()}
    assert stream and stream <= batch and len(batch - stream) <= 2  # only the still-open sessions differ


def _docs(spark, n=200):
    rows = [(f"d{i:03d}", i, ["x", "NSFW"] if i % 17 == 0 else ["x"], "content has been removed" if i % 13 == 0 else "ok",
             i % 29 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, seq long, tags array<string>, literal string, excluded boolean")


def test_dense_positions(spark):
    d = _docs(spark).repartition(5)
    pos = sorted((r.seq, r.pos) for r in sp.dense_positions(d).collect())
    assert [p for _, p in pos] == list(range(1, 201))


def test_dense_positions_many_partitions(spark):
    """Sparse, unordered keys over 8 partitions: every position equals a plain row number, the id column kept."""
    rows = [(f"d{i}", (i * 7919) % 100003 * 3 + (1 << 33) * (i % 3)) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id string, seq long").repartition(8)
    want = {i: p for p, (i, _) in enumerate(sorted(rows, key=lambda r: r[1]), 1)}
    assert {r.doc_id: r.pos for r in sp.dense_positions(d, rows_a_bucket=100).collect()} == want
    assert sp.dense_positions(d.limit(0)).collect() == []


def test_sample_properties(spark):
    d = _docs(spark)
    offs = sp.window_offsets(spark, d.where("not excluded").count(), 30, 7)
    s = sp.sample_windows(d, offs, 30, 7, ("nsfw",)).collect()
    ids = [r.doc_id for r in s]
    assert len(ids) == len(set(ids)) and 0 < len(ids) <= 30
    assert all("NSFW" not in r.tags and r.literal == "ok" and not r.excluded for r in s)
    u = sp.sample_uniform(d, 30, 7, ("nsfw",)).collect()
    assert len(u) == 30 and len({r.doc_id for r in u}) == 30
    empty = sp.window_offsets(spark, 0, 30, 7)
    assert empty.count() == 0


def test_page_scan(spark):
    got = [r.seq for r in sp.page_scan(_docs(spark), 5, 10).collect()]
    ok = [i for i in range(200) if i % 29 != 0]
    assert got == ok[10:15]


def test_dense_positions_of_uneven_numbers(spark):
    """Epochs far apart and an outlier: right positions, and no range holds more than its bound."""
    r = random.Random(4)
    seqs = [e << 40 | i for e in (0, 3, 4) for i in range(4000)] + [1 << 61, (1 << 61) + 7, -5]
    r.shuffle(seqs)
    df = spark.createDataFrame([(x,) for x in seqs], "seq long")
    got = {x.seq: x.pos for x in sp.dense_positions(df, rows_a_bucket=100).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(seqs))}
    ranged, sizes = sp._even_ranges(df, "seq", 100)
    assert sizes.agg(F.max("_n")).first()[0] <= 400 and ranged.count() == len(seqs)
    assert sp.dense_positions(df.limit(0)).collect() == []
