"""Unscored listing and random pages.

Store order is the explicit ``seq`` column. Dense positions over the non-excluded rows
are computed without a global sort, by ranges of ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopdex.functions.moderation import has_blocked_tag, is_removed
from loopdex.operators.util import bounded_broadcast, ensure_cols
from loopdex.session import written

_MOD_COLS = ("literal", "description", "combined_text")


def page_scan(docs: DataFrame, limit: int, offset: int, excluded_col: str = "excluded") -> DataFrame:
    """Store order after exclusion, OFFSET/LIMIT (TakeOrdered of offset+limit rows)."""
    return docs.where(~F.col(excluded_col)).orderBy("seq", "doc_id").offset(offset).limit(limit)


def _even_ranges(docs: DataFrame, order: str, rows_a_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(docs with ``_range``, sizes (_range, _n)): ranges of ``order``, named by their lower bounds, of at most four times
    rows_a_bucket rows each, however unevenly ``order`` is spread (distinct values).

    Ranges that hold more are cut again between their own smallest and largest value, in as many as their rows need."""
    x, rows = F.col(order), F.lit(rows_a_bucket)
    of = docs.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, width = of["low"] or 0, max(1, ((of["high"] or 0) - (of["low"] or 0) + 1) * rows_a_bucket // max(1, of["n"]))
    ranged = docs.withColumn("_range", (F.lit(low) + F.floor((x - F.lit(low)) / F.lit(width)) * F.lit(width)).cast("long"))
    while True:
        sizes = written(ranged.groupBy("_range").agg(F.min(order).cast("long").alias("_low"), F.max(order).cast("long").alias("_high"), F.count(F.lit(1)).alias("_n")), "ranges")
        heavy = sizes.where((F.col("_n") > 4 * rows) & (F.col("_high") > F.col("_low")))
        if not heavy.limit(1).count():
            return ranged, sizes.select("_range", "_n")
        # Widths as doubles only place the cuts; a range is still named by an exact number, and no two share it.
        part = F.greatest(F.lit(1), F.floor((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / rows)))
        cuts = heavy.select("_range", "_low", part.cast("long").alias("_width"))
        inner = F.col("_low") + F.expr(f"(`{order}` - _low) div _width") * F.col("_width")
        ranged = ranged.join(bounded_broadcast(cuts, 100_000), "_range", "left")
        ranged = ranged.withColumn("_range", F.when(F.col("_width").isNotNull(), inner).otherwise(F.col("_range")).cast("long")).drop("_low", "_width")


def dense_positions(docs: DataFrame, order: str = "seq", rows_a_bucket: int = 20_000) -> DataFrame:
    """1-based dense position in ``order`` (an integer column without repeats).

    Rows fall into ranges of ``order`` of bounded size, the same wherever the plan is evaluated. A row's position is the
    number of rows in the ranges before (a running sum over one row a range) plus its place inside its own range. Pass
    narrow rows: they are shuffled by range."""
    ranged, sizes = _even_ranges(docs, order, rows_a_bucket)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    return inside.join(sizes.select("_range", before.alias("_before")), "_range").withColumn("pos", F.col("_before") + F.col("_i")).drop("_range", "_i", "_before")


def sample_windows(docs: DataFrame, offsets: DataFrame, limit: int, seed: int, blocked: tuple[str, ...],
                   excluded_col: str = "excluded") -> DataFrame:
    """G5 with given window offsets (window_no, off, b): windows of b=min(2*limit, T) rows at
    0-based offsets over the non-excluded rows, concatenated in window order; repeated ids
    dropped (first wins) before the moderation filter; then a seeded shuffle and ``limit``.

    Positions and windows work on (doc_id, seq) alone. The offsets are at most five rows, so the
    rows that they pick are at most 10 * limit: both broadcasts are bounded by construction.
    """
    docs = ensure_cols(docs, _MOD_COLS)
    live = docs.where(~F.col(excluded_col))
    pos = dense_positions(live.select("doc_id", "seq"))
    win = pos.join(F.broadcast(offsets), (pos.pos > offsets.off) & (pos.pos <= offsets.off + offsets.b))
    first = win.groupBy("doc_id").agg(F.min(F.struct("window_no", "pos", "seq"))["seq"].alias("seq"))
    pool = live.join(F.broadcast(first), ["doc_id", "seq"])
    kept = pool.where(~is_removed("literal", "description", "combined_text") & ~has_blocked_tag("tags", blocked))
    return kept.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(str(seed)))), "doc_id").limit(limit)


def sample_uniform(docs: DataFrame, limit: int, seed: int, blocked: tuple[str, ...], excluded_col: str = "excluded") -> DataFrame:
    """A seeded uniform page: order by md5(id || seed) (one pass, partial top-n per task)."""
    docs = ensure_cols(docs, _MOD_COLS)
    ok = docs.where(~F.col(excluded_col) & ~is_removed("literal", "description", "combined_text") & ~has_blocked_tag("tags", blocked))
    return ok.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(str(seed)))), "doc_id").limit(limit)


def window_offsets(spark, total: int, limit: int, seed: int):
    """G5 offsets: m = min(5, ceil(T/b)) windows at floor(rnd * max(1, T - b)), b = min(2*limit, T)."""
    import math
    import random

    if total == 0:
        return spark.createDataFrame([], "window_no int, off long, b long")
    b = min(2 * limit, total)
    m = min(5, math.ceil(total / b))
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, int(math.floor(rnd.random() * max(1, total - b))), b) for i in range(m)],
                                 "window_no int, off long, b long")
