"""Token counts from flat, unindexed token files: a vectorised scan for end-of-document ids over fixed-size blocks,
documents that cross block borders stitched together by a prefix scan.

The files hold nothing but little-endian ids. They are listed, cut into blocks of BLOCK_BYTES (whatever the file's
size, so one long file is many tasks), and each block is searched with one vector comparison. A block reports the
places of its ends; what a document has in earlier blocks follows from the last end before the block, a running
maximum over the file's blocks (a few dozen bytes each). No ids leave the scanning tasks.

Edge cases: an empty file has no documents; ids after the last end make one more document with ended = false; two ends
in a row are an empty document (0 tokens besides its end); a file may start or stop anywhere in a block, inside an id
too: the bytes after its last whole id are no id, and their number is in ``torn``; rows that repeat a doc_id are
documents each; an empty table writes no file and gives no rows; extra columns are ignored; an id or a separator that
doesn't fit the width is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loopdex.llm.common import scratch, written

BLOCK_BYTES = 8 << 20


def width_of(tokenizer: str, separator: int) -> int:
    """The least width, 2 or 4 bytes, that holds the separator and every id of a tokenizers file."""
    import json

    spec = json.loads(open(tokenizer, encoding="utf-8").read())
    vocab = spec["model"]["vocab"]
    ids = [x["id"] for x in spec.get("added_tokens") or []] + ([len(vocab) - 1] if isinstance(vocab, list) else list(vocab.values()))
    return 2 if max([separator, *ids]) < 1 << 16 else 4


def blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES, pattern: str = "*.ids") -> DataFrame:
    """(path, block, first, n): the files of folder in blocks; first and n in bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / block_bytes)).cast("int"))).alias("block")
    cut = files.where("length > 0").select("path", "length", at)
    first = F.col("block").cast("long") * block_bytes
    return cut.select("path", "block", first.alias("first"), F.least(F.lit(block_bytes), F.col("length") - first).alias("n"))


def scan(spark: SparkSession, folder: str, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES, pattern: str = "*.ids") -> DataFrame:
    """(path, ordinal, start, n_tokens, ended, torn) of every document; n_tokens counts the end id, torn the bytes of its file
    after the last whole id."""
    from loopdex.llm.files import read_range

    kind = np.dtype({1: "u1", 2: "<u2", 4: "<u4"}[width])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                data = read_range(row["path"], row["first"], row["n"])
                ids = np.frombuffer(data, kind, len(data) // width)
                ends = np.flatnonzero(ids == separator) + (row["first"] // width + 1)
                size = row["first"] // width + len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]], pa.int32()), pa.array([size], pa.int64()), pa.array([len(data) % width], pa.int32()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["path", "block", "size", "torn", "ends"],
                )

    todo = blocks(spark, folder, max(width, block_bytes - block_bytes % width), pattern)  # only a file's end can be torn
    found = todo.repartition(F.col("path"), F.col("block")).mapInArrow(run, "path string, block int, size bigint, torn int, ends array<bigint>")
    found = written(found, "ends")
    # The prefix scan: one narrow row a block, with its number of ends and the last of them.
    file = W.partitionBy("path").orderBy("block")
    narrow = found.select("path", "block", "size", "torn", F.size("ends").cast("long").alias("k"), F.array_max("ends").alias("last"))
    carry = narrow.select(
        "path", "block",
        F.coalesce(F.max("last").over(file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("open"),
        F.coalesce(F.sum("k").over(file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("block").over(file).isNull().alias("is_last"),
        F.max("torn").over(W.partitionBy("path")).alias("torn"),
    )
    rows = found.drop("torn").join(carry, ["path", "block"])
    starts = F.concat(F.array("open"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    closed = F.zip_with(starts, "ends", lambda s, e: F.struct(s.alias("start"), (e - s).alias("n_tokens"), F.lit(True).alias("ended")))
    closed = F.when(F.size("ends") > 0, closed).otherwise(F.array().cast("array<struct<start:bigint,n_tokens:bigint,ended:boolean>>"))
    tail = F.coalesce(F.array_max("ends"), F.col("open"))
    rest = F.when(F.col("is_last") & (tail < F.col("size")), F.array(F.struct(tail.alias("start"), (F.col("size") - tail).alias("n_tokens"), F.lit(False).alias("ended"))))
    docs = F.concat(closed, F.coalesce(rest, F.array().cast("array<struct<start:bigint,n_tokens:bigint,ended:boolean>>")))
    out = rows.select("path", "before", "torn", F.posexplode(docs).alias("i", "d"))
    return out.select("path", (F.col("before") + F.col("i")).alias("ordinal"), "d.start", "d.n_tokens", "d.ended", "torn")


def write_flat(docs: DataFrame, tokenizer: str, folder: str, separator: int, width: int = 2) -> DataFrame:
    """Tokenise documents (doc_id, text) into flat files, an end id after each document; returns, as a table of its
    own, the manifest (path, ordinal, doc_id) that a corpus owner keeps beside such files. Ids equal to the separator
    can't come from a text, as strings of special tokens are encoded as ordinary text."""
    from loopdex.llm.files import make, publish

    if not 0 <= separator < 1 << 8 * width:
        raise ValueError(f"separator {separator} doesn't fit in {width} bytes")
    make(folder)
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from loopdex.llm.byte_tokens import of_process, slices_of

        kind, encode = {2: "<u2", 4: "<u4"}[width], None
        part = TaskContext.get().partitionId()
        for made, whole in enumerate(batches):
            encode = encode or of_process(content.value)
            path, pieces = f"{folder}/tokens-{part:05d}-{made:05d}.ids", []
            for batch in slices_of(whole, "text"):
                ids, sizes = encode(batch.column("text"))
                if len(ids) and ids.max() >= 1 << 8 * width:
                    raise ValueError(f"id {ids.max()} doesn't fit in {width} bytes")
                pieces.append(np.insert(ids, np.cumsum(sizes), separator).astype(kind).tobytes())
            publish(path, pieces)
            name = path.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_arrays([pa.array([name] * whole.num_rows), pa.array(range(whole.num_rows), pa.int64()), whole.column("doc_id")], names=["file", "ordinal", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "file string, ordinal bigint, doc_id bigint"), "manifest")


def counted(docs: DataFrame, tokenizer: str, separator: int, width: int | None = None) -> DataFrame:
    """doc_id, n_tokens (with the end id), ended: flat files written from docs, scanned, and named by the manifest. The width
    is what the vocabulary needs, unless given."""
    width = width or width_of(tokenizer, separator)
    folder = scratch(docs.sparkSession, "flat")
    manifest = write_flat(docs, tokenizer, folder, separator, width)
    found = scan(docs.sparkSession, folder, separator, width).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    return manifest.join(found, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "ended")
