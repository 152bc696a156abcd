"""Shared helpers: table reading, folders every executor can reach, written intermediate tables and word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.session import checkpoint_dir

#: White space is these six characters everywhere in this package; a word is a longest run of anything else.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table (only they reach the scan)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path inside the shared folder that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, outlives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words in a text (null: 0)."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def releasing(run):
    """run (a function of mapInArrow), and after it the memory that Arrow keeps for reuse is given back: workers stay
    alive between tasks, beside whatever the executor does next."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped
