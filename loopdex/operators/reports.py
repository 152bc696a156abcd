"""Progress and outcome reports (E1-E5, E8): single-pass conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex import config as C


def pipeline_status(items: DataFrame) -> DataFrame:
    """Per source total / downloaded / described (map-side partial aggregation)."""
    return items.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("downloaded", F.lit(False))).alias("downloaded"),
        F.count_if(F.coalesce("described", F.lit(False))).alias("described"),
    )


def run_summary(results: DataFrame, elapsed_sec: float | None = None) -> DataFrame:
    """Ok / failed / removed / done counts; rate guarded against elapsed = 0."""
    agg = results.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "removed").alias("removed"),
        F.count(F.lit(1)).alias("done"),
    )
    if elapsed_sec is not None:
        agg = agg.withColumn("rate_per_sec", rate(F.col("done"), elapsed_sec))
    return agg


def rate(count: Column, elapsed_sec: float) -> Column:
    """Count a second; 0 where no time has passed."""
    return (count / F.lit(float(elapsed_sec))).cast("double") if elapsed_sec > 0 else F.lit(0.0)


def cost_estimate(ok_count_col="ok"):
    """ok*1500*0.08/1e6 + ok*150*0.30/1e6, rounded to 4 decimals."""
    ok = F.col(ok_count_col).cast("double")
    c = ok * C.COST_INPUT_TOKENS * C.COST_INPUT_PER_M / 1e6 + ok * C.COST_OUTPUT_TOKENS * C.COST_OUTPUT_PER_M / 1e6
    return F.round(c, 4)


def filter_summary(desc: DataFrame, kept_pred) -> DataFrame:
    """E5: kept and removed (= all - kept) in one pass."""
    return desc.agg(F.count_if(kept_pred).alias("kept"), F.count(F.lit(1)).alias("_all")).select(
        (F.col("_all") - F.col("kept")).alias("removed"), "kept")


def grand_total(results: DataFrame) -> DataFrame:
    """Per-source successes and the grand total in one pass (ROLLUP)."""
    return results.rollup("source").agg(F.count_if(F.col("status") == "ok").alias("succeeded"))
