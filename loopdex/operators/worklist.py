"""Selecting work (C13, D1, D2, F3) and writing status back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopdex.operators.util import top_k_per_group


def needs_description(force: bool = False):
    """Downloaded AND (force OR NOT described); missing flags are false."""
    dl = F.coalesce(F.col("downloaded"), F.lit(False))
    done = F.coalesce(F.col("described"), F.lit(False))
    return dl & (F.lit(True) if force else ~done)


def pending_captions(captions: DataFrame, done_urls: DataFrame, url_col: str = "gif_url") -> DataFrame:
    """Captions whose (rewritten) URL is not in the output; duplicates on the left stay."""
    return captions.join(done_urls.select(F.col(done_urls.columns[0]).alias(url_col)).distinct(), url_col, "left_anti")


def first_n_per_source(items: DataFrame, n: int, force: bool = False) -> DataFrame:
    """the first ``n`` items needing a description per source, in item order (0 = all)."""
    need = items.where(needs_description(force))
    if n == 0:
        return need
    return top_k_per_group(need, "source", [F.col("item_no")], n, "_pos").drop("_pos")


def pending_items(items: DataFrame, done_ids: DataFrame, n: int, force: bool = False) -> DataFrame:
    """First-n per source, then minus the (source, id) already in the output (skipped under force)."""
    first = first_n_per_source(items, n, force)
    if force:
        return first
    return first.join(done_ids.select("source", "id").distinct(), ["source", "id"], "left_anti")


def mark_described(items: DataFrame, succeeded_ids: DataFrame) -> DataFrame:
    """Described := true for the (source, id) that succeeded in this run, others keep their flag."""
    ok = succeeded_ids.select("source", "id", F.lit(True).alias("_ok")).distinct()
    return (items.join(ok, ["source", "id"], "left")
            .withColumn("described", F.when(F.col("_ok"), F.lit(True)).otherwise(F.col("described")))
            .drop("_ok"))


def pack_manifests(items: DataFrame) -> DataFrame:
    """Items back into one manifest row per source, in item order (for the staged rewrite)."""
    cols = ["id", "original_url", "page_url", "title", "local_file", "format", "downloaded", "described"]
    present = [c for c in cols if c in items.columns]
    return (items.groupBy("source_dir", "source")
            .agg(F.sort_array(F.collect_list(F.struct("item_no", *present))).alias("_it"))
            .select("source_dir", "source", F.transform("_it", lambda s: s.dropFields("item_no")).alias("items")))
