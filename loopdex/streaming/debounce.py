"""Per-session debounce of query edits and suppression of repeated queries.

Batch form (skew-safe): events are cut into (session, time-bucket) slices, sessions are
found inside each slice in parallel, and only the first/last session of every slice
(at most two rows per slice) are stitched per session key. A key holding a third of
all events therefore never lands in one sorted window partition.

Stream form: ``withWatermark`` + ``session_window`` in append mode; a session is
emitted once the watermark passes its end. ``replay_debounce`` runs it over a bounded
table and then moves the watermark past the end, so every session is emitted. Forms with state of their
own (submits, repeats) are in ``sessions_state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopdex.functions.text import ws_trim


def _us(ts_col: str):
    return F.unix_micros(F.col(ts_col).cast("timestamp"))


def sessions(events: DataFrame, key: str, ts: str, text: str, gap_us: int, bucket_us: int | None = None, tie: str | None = None,
             ends: str | None = None) -> DataFrame:
    """(key, start_us, last_us, text, n_events, ended): gap-separated sessions; events exactly ``gap`` apart belong to the
    same session, unless the earlier one has the boolean ``ends`` set. ``text`` is the last text and ``ended`` the last
    ``ends`` by time, equal times in the order of ``tie``."""
    b_us = bucket_us or max(8 * gap_us, 3_600_000_000)
    e = events.select(F.col(key).alias("k"), _us(ts).alias("t"), F.col(text).alias("x"), (F.col(tie) if tie else F.lit(0)).alias("o"),
                      (F.col(ends) if ends else F.lit(False)).alias("e")).withColumn("b", F.floor(F.col("t") / F.lit(b_us)))
    w = Window.partitionBy("k", "b").orderBy("t", "o")
    prev = F.lag("t").over(w)
    e = e.withColumn("new", F.when(prev.isNull() | (F.col("t") - prev > gap_us) | F.lag("e").over(w), 1).otherwise(0))
    e = e.withColumn("lid", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = F.struct("t", "o")
    local = e.groupBy("k", "b", "lid").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.max_by("x", by).alias("x"),
                                           F.max_by("e", by).alias("e"), F.count(F.lit(1)).alias("n"))
    nloc = F.max("lid").over(Window.partitionBy("k", "b"))
    local = local.withColumn("edge", (F.col("lid") == 1) | (F.col("lid") == nloc))
    interior = local.where(~F.col("edge")).select("k", "start", "last", "x", "e", "n")
    edge = local.where("edge")
    # Sessions of one slice may begin at one time, if the first is ended by its only event; their number orders them.
    we = Window.partitionBy("k").orderBy("b", "lid")
    plast = F.lag("last").over(we)
    edge = edge.withColumn("new", F.when(plast.isNull() | (F.col("start") - plast > gap_us) | F.lag("e").over(we), 1).otherwise(0))
    edge = edge.withColumn("gid", F.sum("new").over(we.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("b", "lid")
    merged = edge.groupBy("k", "gid").agg(F.min("start").alias("start"), F.max("last").alias("last"),
                                          F.max_by("x", at).alias("x"), F.max_by("e", at).alias("e"), F.sum("n").alias("n"))
    out = interior.unionByName(merged.drop("gid"))
    return out.select(F.col("k").alias(key), F.col("start").alias("start_us"), F.col("last").alias("last_us"),
                      F.col("x").alias(text), F.col("n").cast("long").alias("n_events"), F.col("e").alias("ended"))


def debounce(events: DataFrame, key: str, ts: str, text: str, gap_us: int, kind: str | None = None, cancel: bool = False,
             tie: str | None = None) -> DataFrame:
    """J1 batch: one emission per quiet-gap session (its last text), blank texts suppressed, emitted text not trimmed; rows
    with kind='submit' emit immediately, and with ``cancel`` they take the place of what is pending: the edits before a
    submit, if less than the gap ago, are not emitted again on their own."""
    one = F.lit(1).cast("long")
    if kind is not None and cancel:
        all_ = sessions(events.withColumn("_submit", F.col(kind) == "submit"), key, ts, text, gap_us, tie=tie, ends="_submit").where(ws_trim(text) != "")
        start = F.when(F.col("ended"), F.col("last_us")).otherwise(F.col("start_us"))
        return all_.select(key, F.col("last_us").alias("emit_us"), text, start.alias("start_us"), F.when(F.col("ended"), one).otherwise(F.col("n_events")).alias("n_events"))
    edits = events if kind is None else events.where(F.col(kind) != "submit")
    out = sessions(edits, key, ts, text, gap_us, tie=tie).where(ws_trim(text) != "")
    out = out.select(key, F.col("last_us").alias("emit_us"), text, "start_us", "n_events")
    if kind is not None:
        subs = events.where((F.col(kind) == "submit") & (ws_trim(text) != ""))
        out = out.unionByName(subs.select(key, _us(ts).alias("emit_us"), text, _us(ts).alias("start_us"), one.alias("n_events")))
    return out


def drop_repeats(events: DataFrame, key: str, ts: str, text: str, bucket_us: int = 3_600_000_000, tie: str | None = None) -> DataFrame:
    """Drop a query equal to the previous one of its session (blank resets); equal times in the order of ``tie``.

    The previous text is found inside each (key, time-bucket) slice; the first row of a
    slice looks up the last text of the key's previous non-empty slice from a per-slice
    summary table (at most one row per slice), so no window spans a whole key."""
    e = events.select("*", F.col(key).alias("_k"), _us(ts).alias("_t"), F.col(text).alias("_x"), (F.col(tie) if tie else F.lit(0)).alias("_o")).withColumn(
        "_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_o")
    e = e.withColumn("_prev", F.lag("_x").over(w)).withColumn("_rn", F.row_number().over(w))
    summ = e.groupBy("_k", "_b").agg(F.max_by("_x", F.struct("_t", "_o")).alias("_last_x"))
    summ = summ.withColumn("_prev_b_x", F.lag("_last_x").over(Window.partitionBy("_k").orderBy("_b"))).select("_k", "_b", "_prev_b_x")
    e = e.join(summ, ["_k", "_b"]).withColumn("_prev", F.when(F.col("_rn") == 1, F.col("_prev_b_x")).otherwise(F.col("_prev")))
    keep = (ws_trim("_x") != "") & (F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(F.col("_x")))
    return e.where(keep).drop("_k", "_t", "_x", "_o", "_b", "_prev", "_rn", "_prev_b_x")


def stream_debounce(stream: DataFrame, key: str, ts: str, text: str, gap: str, watermark: str) -> DataFrame:
    """J1 stream: session windows behind a watermark (TIMESTAMP_NTZ is cast first)."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    agg = s.groupBy(F.col(key), F.session_window("_ts", gap).alias("sw")).agg(
        F.max_by(F.col(text), F.col("_ts")).alias(text), F.count(F.lit(1)).alias("n_events"),
        F.min("_ts").alias("_start"), F.max("_ts").alias("_last"))
    return agg.where(ws_trim(text) != "").select(key, F.unix_micros("_last").alias("emit_us"), text,
                                                 F.unix_micros("_start").alias("start_us"), "n_events")


def _replay(spark: SparkSession, path: str, pattern: str, columns: list[str], ts: str, plan, folder: str) -> DataFrame:
    """plan(stream) over a table at rest, with whatever it holds back at the end, read back from ``folder`` (shared by the
    cluster).

    The files at hand are one micro-batch, so none of their rows is late. A second run of the same query (same
    checkpoint) then meets one closing row, a year after the newest event and without a key: it moves the watermark past
    all that waits but itself, which is never emitted."""
    source = spark.read.option("pathGlobFilter", pattern).parquet(path).select(*columns)
    closing = f"{folder}/closing"
    source.limit(0).write.parquet(closing)
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", pattern).parquet(path)
    ends = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(closing)
    out = plan(events.unionByName(ends))

    def run():
        sink = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()

    run()
    after = source.agg((F.max(ts) + F.expr("INTERVAL 1 YEAR")).alias(ts)).where(F.col(ts).isNotNull())
    fields = {f.name: f.dataType for f in source.schema}
    row = after.select(*[F.col(c) if c == ts else F.lit(None).cast(fields[c]).alias(c) for c in source.columns])
    row.write.mode("append").parquet(closing)
    run()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def replay_debounce(spark: SparkSession, path: str, pattern: str, key: str, ts: str, text: str, gap: str, folder: str) -> DataFrame:
    """J1 stream over a table at rest: all sessions."""
    return _replay(spark, path, pattern, [key, ts, text], ts, lambda s: stream_debounce(s, key, ts, text, gap, "1 minute"), folder)
