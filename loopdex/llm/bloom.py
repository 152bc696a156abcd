"""Blocked Bloom filters as DataFrames: one hash picks a 512-bit block, eight bits inside it are set, one in each of the
block's 64-bit words. Blocks are built by a grouped OR. Their number is capped (MOST_BLOCKS: 32 MB of bits), so the
broadcast has a fixed bound whatever the number of keys: more keys only let more false positives through, which the
exact join behind the filter removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
MOST_BLOCKS = 1 << 19
WORDS = 8


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """(block of a key, the word with its bit set for each of the block's words)."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), [F.call_function("shiftleft", F.lit(1).cast("long"), bit(i)) for i in range(WORDS)]


def build(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(one row a non-empty block: block, w0..w7; number of blocks) of a column of keys."""
    blocks = max(1, min(MOST_BLOCKS, -(-n_keys * BITS_A_KEY // 512)))
    block, masks = _places(F.col(key), blocks)
    rows = keys.select(block.alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def with_answer(df: DataFrame, key: str, filter_: tuple[DataFrame, int], name: str) -> DataFrame:
    """df with a boolean column: may the filter hold the row's key? (No row is lost; a null key: false.)"""
    rows, n_blocks = filter_
    rows = F.broadcast(rows.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)]))
    block, masks = _places(F.col(key), n_blocks)
    df = df.withColumn("_at", block).join(rows, F.col("_at") == F.col("_block"), "left")
    hit = F.col(key).isNotNull()
    for i, mask in enumerate(masks):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(mask) == mask)
    return df.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_at", "_block", *[f"_w{i}" for i in range(WORDS)])
