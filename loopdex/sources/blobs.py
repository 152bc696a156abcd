"""A5/K3: binary embedding files (little-endian u64 n, u64 dim, then dim float32).

Spark's ``binaryFile`` source lists and reads the files in parallel; decoding is an
Arrow batch of ``np.frombuffer`` calls. Malformed files get a status, not an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, status string, dim long, embedding array<float>"


def decode_blob(data: bytes):
    if data is None or len(data) < 16:
        return "short_header", None, None
    n, dim = np.frombuffer(data[:16], dtype="<u8")
    if n == 0:
        return "empty", int(dim), None
    need = 16 + 4 * int(dim)
    if len(data) < need:
        return "short_data", int(dim), None
    return "ok", int(dim), np.frombuffer(data[16:need], dtype="<f4").astype(np.float32)


def read_vector_blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(it):
        for pdf in it:
            dec = [decode_blob(b) for b in pdf["content"]]
            yield pd.DataFrame({
                "path": pdf["path"],
                "status": [d[0] for d in dec],
                "dim": pd.array([d[1] for d in dec], dtype="Int64"),
                "embedding": [d[2] for d in dec],
            })

    return raw.mapInPandas(run, SCHEMA).withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
