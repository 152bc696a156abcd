"""Per-source JSON manifests and per-source description files.

One multi-path read over a glob; the source name comes from the file path
(``_metadata.file_path``), directories starting with ``_`` are skipped and a
source filter is part of the glob, so other sources' files aren't even listed.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("original_url", T.StringType()),
    T.StructField("page_url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("local_file", T.StringType()), T.StructField("format", T.StringType()),
    T.StructField("downloaded", T.BooleanType()), T.StructField("described", T.BooleanType()),
])
MANIFEST = T.StructType([T.StructField("source", T.StringType()), T.StructField("items", T.ArrayType(ITEM))])

#: The directory of a source file, which may itself be a folder of part files.
_DIR = r"([^/]+)/(?:manifest\.json|descriptions\.jsonl)(?:/[^/]+)?$"


def _source_dir():
    return F.regexp_extract(F.col("_metadata.file_path"), _DIR, 1)


def _found(spark: SparkSession, glob: str) -> bool:
    """Does any path match a glob?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found) and len(found) > 0


def read_manifests(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """(source_dir, source, items) for every ``<root>/<dir>/manifest.json``."""
    glob = f"{root}/{source or '*'}/manifest.json"
    if not _found(spark, glob):
        return spark.createDataFrame([], "source_dir string, source string, items " + MANIFEST["items"].dataType.simpleString())
    df = (spark.read.schema(MANIFEST).option("multiLine", True).json(glob)
          .select(_source_dir().alias("source_dir"), "source", "items"))
    return df.where(~F.col("source_dir").startswith("_"))


def manifest_items(manifests: DataFrame) -> DataFrame:
    """One row per item with its position in the manifest (item_no, 0-based)."""
    return manifests.select("source_dir", "source", F.posexplode("items").alias("item_no", "item")).select(
        "source_dir", "source", "item_no", "item.*")


def ingest_sources(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """Union of every ``<root>/<dir>/descriptions.jsonl`` (a file or a folder of parts) with its source name, lines
    numbered by source, file and position. Sources without the file are skipped; without any, the result is empty."""
    from loopdex.sources.captions import number_lines
    from loopdex.sources.descriptions import parse_descriptions

    glob = f"{root}/{source or '*'}/descriptions.jsonl"
    if not _found(spark, glob):
        lines = spark.createDataFrame([], "line_no bigint, line string, source_dir string")
    else:
        text = spark.read.text(glob).where(~_source_dir().startswith("_"))
        rows = number_lines(text.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), "value"), keep_file=True)
        lines = rows.select("line_no", "line", F.regexp_extract("_f", _DIR, 1).alias("source_dir"))
    return parse_descriptions(lines, keep=("source_dir",))


def write_sources(rows: DataFrame, root: str, name: str) -> None:
    """Write rows (source_dir, value) as ``<root>/<source_dir>/<name>``: a folder of text parts a source, each put in place by
    one rename. For ``manifest.json``, a row is a whole manifest; a name that exists already is replaced."""
    spark = rows.sparkSession
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    rows.select(F.col("source_dir"), F.col("value")).write.partitionBy("source_dir").text(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(staged)):
        folder = status.getPath().getName()
        if not folder.startswith("source_dir="):
            continue
        target = path(f"{root}/{unquote(folder[len('source_dir='):])}/{name}")
        old = path(f"{root}/_replaced-{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            fs.rename(target, old)
        if not fs.rename(status.getPath(), target):
            raise OSError(f"can't publish {target}")
        fs.delete(old, True)
    fs.delete(path(staged), True)
