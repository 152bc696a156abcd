"""Keystroke-stream plans over ``events`` (session = user_id, text = event_type)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.plans.common import GAP_US
from loopdex.session import checkpoint_dir, scratch
from loopdex.sources import fixtures as fx
from loopdex.streaming import debounce as db
from loopdex.streaming import sessions_state as ss

Q: dict = {}
O: dict = {}


def debounce(spark: SparkSession, sf: str) -> DataFrame:
    """J1 batch: the last text of every quiet-gap session (gap 30 min on this data)."""
    ev = fx.table(spark, sf, "events")
    return db.debounce(ev, "user_id", "ts", "event_type", GAP_US)


_ISL = f"""
e AS (SELECT user_id, epoch_us(ts) AS t, event_type FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {GAP_US} THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM f)"""
O["debounce"] = fx.with_views("""
SELECT user_id, max(t) AS emit_us, arg_max(event_type, t) AS event_type, min(t) AS start_us, count(*) AS n_events
FROM g GROUP BY user_id, sid HAVING regexp_replace(arg_max(event_type, t), '^\\s+|\\s+$', '', 'g') <> ''""", ctes=_ISL)


def drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose text differs from the previous event of the same user."""
    ev = fx.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return db.drop_repeats(ev, "user_id", "ts", "event_type").select("event_id", "user_id", "event_type")


O["drop_repeats"] = """
SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)
WHERE regexp_replace(event_type, '^\\s+|\\s+$', '', 'g') <> '' AND (prev IS NULL OR prev <> event_type)"""


def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """J1 stream: replay ``events`` through a file-source stream and close it; every session, as in ``debounce``."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-debounce-{uuid.uuid4().hex}"
    return db.replay_debounce(spark, sf, "events.parquet", "user_id", "ts", "event_type", "30 minutes", folder)


O["stream_debounce"] = O["debounce"]

def stream_drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """J2 stream: replay ``events``, one string of state a user; the rows of ``drop_repeats``."""
    return ss.replay_drop_repeats(spark, sf, "events.parquet", "event_id", "user_id", "ts", "event_type", scratch(spark, "stream-repeats"))


O["stream_drop_repeats"] = O["drop_repeats"]

#: Event types that stand for a submit in this data.
SUBMITS = ["purchase", "click"]


def debounce_submits(spark: SparkSession, sf: str) -> DataFrame:
    """J1 batch with submits that cancel what is pending."""
    ev = fx.table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type").isin(SUBMITS), "submit").otherwise("edit"))
    return db.debounce(ev, "user_id", "ts", "event_type", GAP_US, kind="kind", cancel=True, tie="event_id")


def stream_debounce_submits(spark: SparkSession, sf: str) -> DataFrame:
    """J1 stream with submits: event-time timers; the rows of ``debounce_submits``."""
    return ss.replay_debounce_submits(spark, sf, "events.parquet", "user_id", "ts", "event_type", SUBMITS, GAP_US, "event_id", scratch(spark, "stream-submits"))


O["debounce_submits"] = O["stream_debounce_submits"] = f"""
WITH e AS (
  SELECT user_id, epoch_us(ts) AS t, event_id, event_type, event_type IN ('{"', '".join(SUBMITS)}') AS submit FROM events),
f AS (
  SELECT *, lead(t) OVER w AS next_t, lead(submit) OVER w AS next_submit,
         CASE WHEN t - lag(t) OVER w <= {GAP_US} AND NOT lag(submit) OVER w THEN 0 ELSE 1 END AS new
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM f)
SELECT user_id, t AS emit_us, event_type, t AS start_us, CAST(1 AS BIGINT) AS n_events FROM e WHERE submit AND trim(event_type) <> ''
UNION ALL
SELECT user_id, max(t), arg_max(event_type, struct_pack(t := t, i := event_id)), min(t), count(*)
FROM g GROUP BY user_id, sid HAVING NOT bool_or(submit) AND trim(arg_max(event_type, struct_pack(t := t, i := event_id))) <> ''"""

Q.update({"stream_drop_repeats": stream_drop_repeats, "debounce_submits": debounce_submits,
          "stream_debounce_submits": stream_debounce_submits, "debounce": debounce, "drop_repeats": drop_repeats, "stream_debounce": stream_debounce})
