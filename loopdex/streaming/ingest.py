"""Resumable ingest of description files into the document store.

A file-source stream with a checkpoint remembers which files were processed; each
micro-batch is upserted (last write wins) into a bucketed store with ``foreachBatch``, and
``trigger(availableNow=True)`` drains what is new and stops, so re-running processes
only new files. Only the buckets of a batch's documents are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.functions.text import action_text  # noqa: F401  (documented dependency)
from loopdex.sources.captions import number_lines, placed
from loopdex.operators.bucket_store import apply_batch
from loopdex.sources.descriptions import good, parse_descriptions


def to_docs(desc: DataFrame, default_attribution: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Description records -> store rows (doc_id, seq, gif_url, ..., combined_text)."""
    from loopdex.functions.text import combined_text, default_attribution as dattr, doc_id

    return desc.select(
        doc_id("id", "url").alias("doc_id"), F.col("line_no").alias("seq"), F.col("url").alias("gif_url"),
        "original_description", "literal", "source", "mood", "action", "context", "tags",
        dattr("attribution", default_attribution).alias("attribution"),
        combined_text("literal", "source", "mood", "action", "context", "tags").alias("combined_text"), *keep)


def stream_ingest(spark: SparkSession, src_dir: str, store_path: str, checkpoint: str, writer: str = "stream", files: int | None = None) -> None:
    """Drain new JSONL files under ``src_dir`` into the bucketed store at ``store_path`` (read it with
    ``bucket_store.read_store``), at most ``files`` of them a batch.

    A batch rewrites the buckets of its documents alone. Its number is recorded with its commit, so one that Spark plays
    again after a failure changes nothing. One writer name belongs to one checkpoint."""
    reader = spark.readStream.format("text")
    lines = placed((reader if files is None else reader.option("maxFilesPerTrigger", files)).load(src_dir))

    def apply(batch: DataFrame, epoch: int) -> None:
        b = number_lines(batch).withColumn("line_no", F.lit(epoch).cast("long") * F.lit(1 << 40) + F.col("line_no"))
        apply_batch(spark, store_path, to_docs(good(parse_descriptions(b))), writer, epoch)

    q = (lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
