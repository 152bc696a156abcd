"""J1 with submits and J2 as streams with arbitrary state (transformWithState).

State is one small value a session, in the RocksDB state store that transformWithState needs (``state_store`` turns it on for
a session that has none). Rows of a session that arrive together are handled in event order, equal times in the order of a
tie column; rows older than the watermark are dropped by Spark before they come here.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loopdex.functions.text import ws_trim
from loopdex.streaming.debounce import _replay, _us

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a session's last query is remembered after its last event.
KEEP_MS = 24 * 3600 * 1000


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The state store that these streams need, for as long as the context lasts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["us", "tie"], kind="stable")


def _one(state):
    return state.get() if state.exists() else None


class _Repeats(StatefulProcessor):
    """Keeps the text of the session's last event; an event passes if it isn't blank and differs from that."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "text string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        before = _one(self.last)
        before = before[0] if before is not None else None
        previous = [before, *pdf["text"].tolist()[:-1]]
        passes = [not blank and (p is None or p != t) for t, p, blank in zip(pdf["text"], previous, pdf["blank"])]
        self.last.update((pdf["text"].iloc[-1],))
        yield pdf.loc[passes, ["id", "key", "text"]]


def stream_drop_repeats(stream: DataFrame, id_col: str, key: str, ts: str, text: str, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """J2 stream: (id_col, key, text) of the events whose text differs from the one before in their session; a blank text
    resets it. ``id_col`` also orders events of one time. A session's text is forgotten keep_ms after its last event was
    seen (None: never). Spark runs batches without data for as long as such a time to live is set, so a run that is
    to end by itself (``availableNow``) needs None."""
    rows = stream.where(F.col(key).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(key).alias("key"), _us(ts).alias("us"), F.col(id_col).alias("tie"), F.col(text).alias("text"),
        F.coalesce(ws_trim(text) == "", F.lit(True)).alias("blank"))
    kinds = dict(rows.dtypes)
    out = rows.groupBy("key").transformWithStateInPandas(_Repeats(keep_ms), f"id {kinds['id']}, key {kinds['key']}, text string", "Append", "None" if keep_ms is None else "ProcessingTime")
    return out.select(F.col("id").alias(id_col), F.col("key").alias(key), F.col("text").alias(text))


class _Pending(StatefulProcessor):
    """Keeps the edits since the last emission as (start, last, text, n) and a timer for when their gap has passed."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "start long, last long, text string, blank boolean, n long")

    def _due(self, last: int) -> int:
        """The first millisecond after the gap: an event exactly a gap later still belongs to the session."""
        return (last + self.gap_us) // 1000 + 1

    @staticmethod
    def _rows(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "emit_us", "text", "start_us", "n_events"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], _one(self.pending)
        if now is not None:
            self.handle.deleteTimer(self._due(now[1]))

        def emit():
            if now is not None and not now[3]:
                out.append((key[0], now[1], now[2], now[0], now[4]))

        pdf = _in_order(rows)
        for us, text, blank, submit in zip(pdf["us"].tolist(), pdf["text"].tolist(), pdf["blank"].tolist(), pdf["submit"].tolist()):
            if now is not None and us - now[1] > self.gap_us:
                emit()
                now = None
            if submit:
                now = None  # takes the place of what is pending
                if not blank:
                    out.append((key[0], us, text, us, 1))
            elif now is None:
                now = (us, us, text, blank, 1)
            else:
                now = (now[0], max(us, now[1]), text if us >= now[1] else now[2], blank if us >= now[1] else now[3], now[4] + 1)
        if now is None:
            self.pending.clear()
        else:
            self.pending.update(now)
            self.handle.registerTimer(self._due(now[1]))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = _one(self.pending)
        self.pending.clear()
        yield self._rows([(key[0], now[1], now[2], now[0], now[4])] if now is not None and not now[3] else [])


def stream_debounce_submits(stream: DataFrame, key: str, ts: str, text: str, submit: str, gap_us: int, watermark: str, tie: str) -> DataFrame:
    """J1 stream with submits: (key, emit_us, text, start_us, n_events). A row whose boolean ``submit`` is set is emitted with
    its micro-batch and cancels the edits that wait; edits are emitted when an event or the watermark passes their gap."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    rows = rows.select(
        F.col(key).alias("key"), "_ts", _us(ts).alias("us"), F.col(tie).alias("tie"), F.col(text).alias("text"),
        F.coalesce(ws_trim(text) == "", F.lit(True)).alias("blank"), F.coalesce(F.col(submit), F.lit(False)).alias("submit"))
    kinds = dict(rows.dtypes)
    out = rows.groupBy("key").transformWithStateInPandas(
        _Pending(gap_us), f"key {kinds['key']}, emit_us long, text string, start_us long, n_events long", "Append", "EventTime")
    return out.where(F.col("key").isNotNull()).select(F.col("key").alias(key), "emit_us", F.col("text").alias(text), "start_us", "n_events")


def replay_drop_repeats(spark: SparkSession, path: str, pattern: str, id_col: str, key: str, ts: str, text: str, folder: str) -> DataFrame:
    """J2 stream over a table at rest."""
    with state_store(spark):
        return _replay(spark, path, pattern, [id_col, key, ts, text], ts, lambda s: stream_drop_repeats(s, id_col, key, ts, text, None), folder)


def replay_debounce_submits(spark: SparkSession, path: str, pattern: str, key: str, ts: str, text: str, submits: list[str], gap_us: int,
                            tie: str, folder: str) -> DataFrame:
    """J1 stream with submits over a table at rest; rows whose text is among ``submits`` are submits."""
    with state_store(spark):
        plan = lambda s: stream_debounce_submits(s.withColumn("_submit", F.col(text).isin(submits)), key, ts, text, "_submit", gap_us, "1 minute", tie)
        return _replay(spark, path, pattern, [key, ts, text, tie], ts, plan, folder)
