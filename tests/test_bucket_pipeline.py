"""The bucketed store, the resumable chain of one source, observed counts and streams with state."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loopdex.operators import bucket_store as bs
from loopdex.operators import pipeline as pl
from loopdex.operators import store as st
from loopdex.operators.ingest_run import embedded_lines, ingest
from loopdex.plans.source_plans import FailsOn
from loopdex.sources import manifests as mf
from loopdex.streaming import debounce as db
from loopdex.streaming import sessions_state as ss

ROWS = "doc_id string, seq long, value string"


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "value").collect()))


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def test_batches_touch_their_buckets_only(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    first = spark.createDataFrame([(f"d{i}", i, f"v{i}") for i in range(200)], ROWS)
    got = bs.apply_batch(spark, root, first, "a", 0, buckets=16)
    assert got == {"rows": 200, "touched": 16, "buckets": 16}
    before = files(root)
    update = spark.createDataFrame([("d3", 300, "new"), ("d3", 299, "older"), ("x", 301, "added")], ROWS)
    got = bs.apply_batch(spark, root, update, "a", 1)
    assert 1 <= got["touched"] <= 2 and got["rows"] < 50
    after = files(root)
    assert {p: t for p, t in after.items() if p in before} == before  # nothing that was written is changed
    want = dict([(f"d{i}", f"v{i}") for i in range(200)] + [("d3", "new"), ("x", "added")])
    assert rows(bs.read_store(spark, root)) == sorted(want.items())
    live = {str(p).split("/data/")[1].split("/")[0] for p in bs.read_store(spark, root).inputFiles()}
    assert len(live) == 2  # untouched buckets are still read from the first version


def test_replayed_batch_is_a_no_op(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    df = spark.createDataFrame([("a", 1, "x")], ROWS)
    assert bs.apply_batch(spark, root, df, "w", 4)["rows"] == 1
    later = spark.createDataFrame([("a", 2, "y")], ROWS)
    assert bs.apply_batch(spark, root, later, "other", 0)["rows"] == 1
    state = files(root)
    assert bs.apply_batch(spark, root, df, "w", 4) is None and bs.apply_batch(spark, root, df, "w", 3) is None
    assert files(root) == state and rows(bs.read_store(spark, root)) == [("a", "y")]


def test_a_batch_that_dies_changes_nothing(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/store"
    bs.apply_batch(spark, root, spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], ROWS), "w", 0)
    with monkeypatch.context() as m:
        m.setattr(bs, "publish_text", lambda *a: (_ for _ in ()).throw(OSError("died before the commit")))
        with pytest.raises(OSError):
            bs.apply_batch(spark, root, spark.createDataFrame([("a", 2, "lost")], ROWS), "w", 1)
    assert rows(bs.read_store(spark, root)) == [("a", "x"), ("b", "x")]
    bs.apply_batch(spark, root, spark.createDataFrame([("a", 2, "y")], ROWS), "w", 1)
    assert rows(bs.read_store(spark, root)) == [("a", "y"), ("b", "x")]
    assert bs.clean(spark, root, keep=1) >= 1 and rows(bs.read_store(spark, root)) == [("a", "y"), ("b", "x")]


def test_store_edges(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    with pytest.raises(FileNotFoundError):
        bs.read_store(spark, root)
    assert bs.apply_batch(spark, root, spark.createDataFrame([], ROWS), "w", 0)["touched"] == 0
    assert bs.read_store(spark, root).count() == 0
    bs.apply_batch(spark, root, spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], ROWS), "w", 1)
    wider = spark.createDataFrame([("c", 2, "z", 7)], ROWS + ", more int")
    bs.apply_batch(spark, root, wider, "w", 2, remove=spark.createDataFrame([("b",), ("gone",)], "doc_id string"))
    got = sorted((r.doc_id, r.value, r.more) for r in bs.read_store(spark, root).collect())
    assert got == [("a", "x", None), ("c", "z", 7)]
    path = f"{tmp_dir}/commit.json"
    bs.publish_text(spark, path, "one")
    with pytest.raises(OSError, match="another run"):
        bs.publish_text(spark, path, "two")
    assert bs.read_text(spark, path) == "one"


def sources(spark, root):
    item = lambda i, **kw: dict(id=f"item_{i}", original_url=f"http://x/{i}.gif", downloaded=i % 5 != 0, **kw)
    for name, a, b in (("alpha", 0, 30), ("beta", 30, 50)):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/manifest.json", "w") as f:
            json.dump({"source": name, "items": [item(i, page_url=f"http://p/{i}") if i % 2 else item(i) for i in range(a, b)]}, f)


def recorded(pdf):
    return pdf["id"].map(lambda i: "no" if i.endswith("7") else json.dumps({"literal": f"seen {i}", "url": f"http://own/{i}.gif", "odd": {"k": i}}))


def held(spark, root):
    store = sorted((r.doc_id, r.gif_url, r.literal, r.attribution) for r in bs.read_store(spark, f"{root}/_store").collect())
    items = sorted((r.id, r.described) for r in mf.manifest_items(mf.read_manifests(spark, root, "alpha")).collect())
    out = sorted(r.value for r in spark.read.text(f"{root}/alpha/descriptions.jsonl").collect())
    return store, items, out


@pytest.mark.parametrize("cut", ["describe", "describe-late", "mark", "ingest"])
def test_pipeline_one_resumes(spark, tmp_dir, monkeypatch, cut):
    """A run that dies in or right after a stage, and is started again, ends like one that didn't."""
    whole, broken = f"{tmp_dir}/whole", f"{tmp_dir}/broken"
    for root in (whole, broken):
        os.makedirs(root)
        sources(spark, root)
    run = lambda root: pl.pipeline_one(spark, root, "alpha", 1, recorded, f"{root}/_store", attribution="none")
    counts = run(whole)
    assert counts["describe"] == {"ok": 21, "failed": 3} and counts["ingest"]["rows"] == 21
    with monkeypatch.context() as m:
        real = pl.publish_text

        def publish(spark_, path, text):  # the stage is through, its record is lost
            if cut == "describe-late" and path.endswith("-describe.json"):
                raise OSError("cut")
            real(spark_, path, text)

        m.setattr(pl, "publish_text", publish)
        if cut != "describe-late":
            m.setattr(pl, {"describe": "_describe", "mark": "_mark", "ingest": "ingest"}[cut], lambda *a, **k: (_ for _ in ()).throw(OSError("cut")))
        with pytest.raises(OSError, match="cut"):
            run(broken)
    run(broken)
    assert held(spark, broken) == held(spark, whole)
    state = files(f"{broken}/_store")
    assert run(broken)["mark"] == {} and files(f"{broken}/_store") == state  # a run that is through changes nothing
    store, items, out = held(spark, whole)
    assert all(url.startswith("http://own/") for _, url, _, _ in store) and sum(bool(d) for _, d in items) == 21 and all('"odd"' in x for x in out)
    assert mf.manifest_items(mf.read_manifests(spark, whole, "beta")).where("described").count() == 0
    again = pl.pipeline_one(spark, whole, "alpha", 2, recorded, f"{whole}/_store")
    assert again["describe"] == {"failed": 3}  # what is described isn't asked again


def test_sources_skip_and_order(spark, tmp_dir):
    assert mf.read_manifests(spark, f"{tmp_dir}/none").count() == 0 and mf.ingest_sources(spark, f"{tmp_dir}/none").count() == 0
    os.makedirs(f"{tmp_dir}/empty/a")
    assert mf.read_manifests(spark, f"{tmp_dir}/empty").count() == 0 and mf.ingest_sources(spark, f"{tmp_dir}/empty").count() == 0
    line = lambda i: json.dumps({"id": i, "url": "u"})
    for d, ids in (("a", ["a0", "a1"]), ("b", [f"b{i}" for i in range(3000)]), ("_x", ["x"])):
        os.makedirs(f"{tmp_dir}/s/{d}")
        with open(f"{tmp_dir}/s/{d}/descriptions.jsonl", "w") as f:
            f.write("\n".join(map(line, ids)))
    got = [(r.source_dir, r.id) for r in mf.ingest_sources(spark, f"{tmp_dir}/s").orderBy("line_no").collect()]
    assert got == [("a", "a0"), ("a", "a1"), *(("b", f"b{i}") for i in range(3000))]
    assert [r.id for r in mf.ingest_sources(spark, f"{tmp_dir}/s", "a").orderBy("line_no").collect()] == ["a0", "a1"]


def test_filter_store_counts(spark, tmp_dir):
    path = f"{tmp_dir}/d.jsonl"
    lines = ['{"literal":"fine"}', '{"literal":"Content HAS been removed."}', "{broken", "", '{"mood":"x"}']
    with open(path, "w") as f:
        f.write("\n".join(lines))
    assert st.filter_store(spark, path) == {"removed": 1, "kept": 4}
    assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(x for x in lines if "removed" not in x)


def test_ingest_counts_and_drops_failures(spark, tmp_dir):
    lines = [json.dumps({"id": f"i{i}", "url": "u", "literal": "bad" if i % 4 == 1 else "good"}) for i in range(20)] + ["{", '{"mood":[1]}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    good, counts = embedded_lines(df, FailsOn("bad"))
    assert counts == {"lines": 22, "skipped": 2, "embed_failed": 5} and good.count() == 15
    assert ingest(df, f"{tmp_dir}/store", "w", 0, FailsOn("bad")) == {**counts, "rows": 15, "touched": bs.read_store(spark, f"{tmp_dir}/store").select(bs._bucket("doc_id", bs.BUCKETS)).distinct().count(), "buckets": 64}
    assert bs.read_store(spark, f"{tmp_dir}/store").where("embedding IS NULL").count() == 0
    assert ingest(df, f"{tmp_dir}/store", "w", 0, FailsOn("bad")) is None


# -- streams with state -----------------------------------------------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)
EVENTS = "i long, k long, ts timestamp, x string"


def events(seed, n=300):
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 10, 200, 300, 301, 900])
        out.append((i, r.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(milliseconds=t), r.choice(["a", "b", "GO", " ", ""])))
    return out


def put(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def drained(spark, out, folder):
    with ss.state_store(spark):
        sink = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination(120)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def test_stream_repeats_over_batches(spark, tmp_dir):
    """State carries a session's last text over micro-batches and restarts."""
    rows = events(1)
    os.makedirs(f"{tmp_dir}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_dir}/in")
    for a, b in ((0, 120), (120, 130), (130, 300)):
        put(spark, rows[a:b], f"{tmp_dir}/in")
        got = drained(spark, ss.stream_drop_repeats(stream, "i", "k", "ts", "x", None), tmp_dir)
    want = db.drop_repeats(spark.createDataFrame(rows, EVENTS), "k", "ts", "x", tie="i")
    assert sorted(map(tuple, got.collect())) == sorted((r.i, r.k, r.x) for r in want.collect())


def test_stream_repeats_are_forgotten(spark, tmp_dir):
    """With a time to live, a session's text goes once it has passed: the repeat is a query again."""
    put(spark, [(0, 1, T0, "a")], f"{tmp_dir}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_dir}/in")
    out = ss.stream_drop_repeats(stream, "i", "k", "ts", "x", keep_ms=1500)
    with ss.state_store(spark):
        q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_dir}/state").trigger(processingTime="200 milliseconds").start(f"{tmp_dir}/out")
        seen = lambda: spark.read.schema(out.schema).parquet(f"{tmp_dir}/out").count()
        end = time.time() + 60
        while time.time() < end and (not os.path.isdir(f"{tmp_dir}/out/_spark_metadata") or seen() < 1):
            time.sleep(0.2)
        time.sleep(3)
        put(spark, [(1, 1, T0 + dt.timedelta(seconds=9), "a")], f"{tmp_dir}/in")
        while time.time() < end and seen() < 2:
            time.sleep(0.2)
        q.stop()
    assert seen() == 2


def test_submits_cancel_what_waits(spark):
    ms = lambda x: T0 + dt.timedelta(milliseconds=x)
    rows = [(0, 1, ms(0), "ca"), (1, 1, ms(50), "GO"), (2, 1, ms(100), "dog"), (3, 1, ms(500), "GO"), (4, 2, ms(0), "x"), (5, 2, ms(0), "y"), (6, 3, ms(0), "GO"), (7, 3, ms(0), "GO")]
    df = spark.createDataFrame(rows, EVENTS).withColumn("kind", F.when(F.col("x") == "GO", "submit").otherwise("edit"))
    out = db.debounce(df, "k", "ts", "x", 300_000, kind="kind", cancel=True, tie="i").collect()
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert sorted((r.k, r.emit_us // 1000 - base, r.x, r.n_events) for r in out) == [(1, 50, "GO", 1), (1, 100, "dog", 1), (1, 500, "GO", 1), (2, 0, "y", 2), (3, 0, "GO", 1), (3, 0, "GO", 1)]


def test_stream_submits_equal_batch(spark, tmp_dir):
    """The batch form, whatever the slices of time it cuts, and the stream over several micro-batches."""
    rows = events(7)
    df = spark.createDataFrame(rows, EVENTS).withColumn("kind", F.when(F.col("x") == "GO", "submit").otherwise("edit"))
    cols = ["k", "emit_us", "x", "start_us", "n_events"]
    want = sorted(tuple(r[c] for c in cols) for r in db.debounce(df, "k", "ts", "x", 300_000, kind="kind", cancel=True, tie="i").collect())
    tagged = df.withColumn("_s", F.col("kind") == "submit")
    small = db.sessions(tagged, "k", "ts", "x", 300_000, bucket_us=700_000, tie="i", ends="_s")
    big = db.sessions(tagged, "k", "ts", "x", 300_000, bucket_us=10**12, tie="i", ends="_s")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))
    os.makedirs(f"{tmp_dir}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_dir}/in").withColumn("_s", F.col("x") == "GO")
    late = (10**6, None, T0 + dt.timedelta(days=400), None)
    for part in (rows[:100], rows[100:105], rows[105:], [late]):
        put(spark, part, f"{tmp_dir}/in")
        got = drained(spark, ss.stream_debounce_submits(stream, "k", "ts", "x", "_s", 300_000, "1 minute", "i"), tmp_dir)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want
