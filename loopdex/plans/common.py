"""Shared pieces of the plans: fixture parameters and column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loopdex.session import scratch

# Fixture parameters (the oracles use the same numbers).
HEAD_LIMIT = 100
ROUND_LIMIT, ROUND_BATCH = 120, 50
PER_SOURCE_LIMIT = 10
DEFAULT_ATTRIBUTION = "http://example.com/default"
GAP_US = 30 * 60 * 1_000_000  # 30 minutes: the fixture's smallest gaps are seconds apart
SAMPLE_LIMIT, SAMPLE_SEED = 30, 42
PAGE_LIMIT, PAGE_OFFSET = 50, 100
KNN_K = 10
BM25_K = 10
BLOCKED = ("nsfw",)
ELAPSED_SEC = 8.0  # the time that reports of a run divide by


def joined(col, sep: str = "|") -> Column:
    """Arrays are compared as joined strings (null elements as '∅', null array stays null)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("∅"))), sep)


def duck_joined(expr: str, sep: str = "|") -> str:
    return f"array_to_string(list_transform({expr}, lambda x: coalesce(CAST(x AS VARCHAR), '∅')), '{sep}')"


def remap_update_id(custkey_col: str = "c_custkey") -> str:
    """Update keys mapped onto fixture doc ids (same expression in both engines)."""
    return f"concat('gif_', substr(md5(CAST({custkey_col} % 100 AS STRING)), 1, 16))"


_BUILT: dict[tuple, tuple] = {}


def built(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], object]) -> str:
    """The folder of something that ingest writes once and queries read (an index, a store): written by write(path) when first
    asked for in this session, and again when an input has changed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def state(path: str) -> tuple:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        whole = fs.getContentSummary(at)
        return whole.getLength(), whole.getFileCount(), fs.getFileStatus(at).getModificationTime()

    key, now = (spark.sparkContext.applicationId, name, *inputs), [state(p) for p in inputs]
    if key not in _BUILT or _BUILT[key][1] != now:
        path = scratch(spark, name)
        write(path)
        _BUILT[key] = (path, now)
    return _BUILT[key][0]
