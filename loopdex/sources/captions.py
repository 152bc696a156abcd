"""Caption TSV lines (url <TAB> caption) as a DataFrame.

Line order is carried as an explicit ``line_no`` column: Spark has no implicit row
order, and head limits, batch edges and last-write-wins all depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopdex.functions.text import hash_doc_id, media_id, rewrite_cdn, ws_trim


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) from text files; line_no counts lines from 0 by file path, then position."""
    return number_lines(placed(spark.read.text(path)))


def placed(text: DataFrame) -> DataFrame:
    """Rows of a (batch or streaming) text source with the file and split that they come from."""
    return text.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), "value")


def number_lines(text: DataFrame, keep_file: bool = False) -> DataFrame:
    """(line_no, line) of rows as ``placed`` gives them, with their file as ``_f`` if it is kept.

    Spark orders splits by size, so the order is taken from each row's file and split. Lines are counted per split,
    the counts of the splits before (one row a split) give its first number, and a row adds its place in the split."""
    rows = text.select("_f", "_b", F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    sizes = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1
    return (rows.withColumn("_p", place).join(sizes.select("_f", "_b", before.alias("_before")), ["_f", "_b"])
            .select((F.col("_before") + F.col("_p")).alias("line_no"), "line", *(["_f"] if keep_file else [])))


def parse_captions(lines: DataFrame, mode: str = "raw") -> DataFrame:
    """Split each line at the first tab; keep lines with two parts.

    mode='raw'   keeps ``url\\t`` as an empty caption (vector-ingest flavour);
    mode='strip' strips the whole line first, so such a line has one part and is dropped.
    Returns (line_no, url, description, valid).
    """
    text = ws_trim("line") if mode == "strip" else F.col("line")
    parts = F.split(text, "\t", 2)
    return lines.select(
        "line_no",
        F.when(F.size(parts) == 2, parts[0]).alias("url"),
        F.when(F.size(parts) == 2, parts[1]).alias("description"),
        (F.size(parts) == 2).alias("valid"),
    )


def caption_docs(captions: DataFrame) -> DataFrame:
    """C1-C3 on valid captions: rewritten URL, media id and hashed document id."""
    v = captions.where("valid").withColumn("gif_url", rewrite_cdn("url"))
    return v.select("line_no", "gif_url", "description", media_id("gif_url").alias("tumblr_id"),
                    hash_doc_id("gif_url").alias("doc_id"))


def head_limit(captions: DataFrame, n: int) -> DataFrame:
    """First ``n`` valid captions in line order; 0 = all (TakeOrdered, no full sort)."""
    v = captions.where("valid")
    return v if n == 0 else v.orderBy("line_no").limit(n)


def batch_rounded_limit(captions: DataFrame, limit: int, batch: int) -> DataFrame:
    """The ingest loop tests its limit only after a full batch, so it imports
    ``min(total, ceil(limit/batch)*batch)`` valid lines (0 = all)."""
    v = captions.where("valid")
    if limit == 0:
        return v
    edge = -(-limit // batch) * batch
    return v.orderBy("line_no").limit(edge)
