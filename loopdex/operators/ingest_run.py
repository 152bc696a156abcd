"""One ingest run, from description lines to the store, and its counts.

Every line is parsed and embedded once, in one written pass; the counts are observed beside that write, so nothing is read a
second time for them. Lines that don't parse are skipped, documents whose vector fails are dropped, both are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loopdex import config as C
from loopdex.operators.bucket_store import apply_batch
from loopdex.operators.embedder import Embedder, embed
from loopdex.operators.reports import rate
from loopdex.operators.sample import dense_positions
from loopdex.session import scratch
from loopdex.sources.descriptions import parse_descriptions
from loopdex.streaming.ingest import to_docs


def embedded_lines(lines: DataFrame, embedder: Embedder | None = None, attribution: str | None = None) -> tuple[DataFrame, dict]:
    """(documents with their vector, counts): lines (line_no, line) parsed, flattened and embedded.

    counts: lines, skipped (not a description), embed_failed."""
    spark = lines.sparkSession
    parsed = parse_descriptions(lines)
    docs = to_docs(parsed, attribution, keep=("reject",))
    # A rejected line has no text to embed; its features are null and its error is of no interest.
    rows = embed(docs.withColumn("_text", F.when(F.col("reject").isNull(), F.col("combined_text"))), "_text", embedder)
    failed = F.col("reject").isNull() & F.col("embedding").isNull()
    seen, path = Observation(), scratch(spark, "ingested")
    rows = rows.observe(seen, F.count("*").alias("lines"), F.count("reject").alias("skipped"), F.count_if(failed).alias("embed_failed"))
    rows.drop("_text").write.parquet(path)
    good = spark.read.schema(rows.drop("_text").schema).parquet(path).where("reject IS NULL AND embedding IS NOT NULL")
    return good.drop("reject", "embed_error"), dict(seen.get)


def ingest_summary(good: DataFrame, counts: dict, batch: int = C.TEXT_BATCH, elapsed_sec: float | None = None) -> DataFrame:
    """Lines, skipped, embed_failed, imported (distinct ids a batch of so many documents, in line order), distinct_docs
    and, where the time is known, the rate of imports a second (0 where no time has passed)."""
    pos = dense_positions(good.select("doc_id", "seq"), "seq")
    batched = pos.select("doc_id", F.floor((F.col("pos") - 1) / F.lit(batch)).alias("batch_no"))
    out = batched.agg(F.count_distinct("batch_no", "doc_id").alias("imported"), F.count_distinct("doc_id").alias("distinct_docs"))
    out = out.select(*[F.lit(counts[k]).cast("long").alias(k) for k in ("lines", "skipped", "embed_failed")], "*")
    return out if elapsed_sec is None else out.withColumn("rate_per_sec", rate(F.col("imported"), elapsed_sec))


def ingest(lines: DataFrame, root: str, writer: str, batch: int, embedder: Embedder | None = None, attribution: str | None = None) -> dict | None:
    """Ingest lines into the bucketed store at root as one batch of a writer; the counts of the run, with those of
    ``apply_batch``, or None where the batch was already applied."""
    good, counts = embedded_lines(lines, embedder, attribution)
    written = apply_batch(lines.sparkSession, root, good, writer, batch)
    return None if written is None else {**counts, **written}
