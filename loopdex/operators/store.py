"""Document store mutations (B1-B6, F2) on parquet tables.

Writes go to a staged directory next to the target and are swapped in afterwards,
so a failed job never leaves a half-written store (B6/O15). Everything is a set
operation: last-write-wins is a window (or ``max_by``) per key, deletes are anti-joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loopdex.functions.moderation import is_removed


def latest_per_key(updates: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """the last row per key by input order (aggregation with map-side partials,
    so a hot key costs one partial row per task, not a sorted window partition)."""
    cols = [c for c in updates.columns if c != key]
    last = F.max_by(F.struct(*cols), F.col(order))
    return updates.groupBy(key).agg(last.alias("_r")).select(key, "_r.*")


def upsert(store: DataFrame, updates: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """B1: store rows without an update, plus the latest update per key."""
    latest = latest_per_key(updates, key, order)
    return store.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def delete(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """B2: remove listed ids."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at path, in whatever file system it names?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _swap(spark: SparkSession, staged: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(conf)
    # The old folder is kept under another name until the new one stands; a failed rename puts it back.
    old = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(path)
    if had and not fs.rename(path, old):
        raise OSError(f"can't move {target} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), path):
        if had:
            fs.rename(old, path)
        raise OSError(f"can't publish {staged} as {target}")
    if had:
        fs.delete(old, True)


def write_staged(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Write to ``<target>.staged-<uuid>`` then rename over the target (the old one stays beside it until then)."""
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").format(fmt).save(staged)
    _swap(df.sparkSession, staged, target)


def ensure_store(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    """Create the table if absent; an existing table is success."""
    loc = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{loc}")


def write_descriptions(df: DataFrame, path: str, mode: str) -> None:
    """JSON lines out; ``mode`` is 'append' or 'overwrite' (see ``output_mode``)."""
    df.write.mode(mode).json(path)


def output_mode(flavour: str, resume: bool = False, any_existing: bool = False, force: bool = False) -> str:
    """B3 rule: captions append iff resume; manifests append iff an existing id was read
    (and not forced)."""
    if flavour == "captions":
        return "append" if resume else "overwrite"
    return "append" if (any_existing and not force) else "overwrite"


def filter_removed_literal(desc: DataFrame) -> DataFrame:
    """Description records without removed content (the file filter checks literal only)."""
    return desc.where(~is_removed("literal"))


def filter_store(spark: SparkSession, path: str, target: str | None = None) -> dict:
    """Rewrite a description file (or a folder of parts) without the records whose literal is removed content;
    ``removed`` and ``kept`` are observed in the same pass. Lines that aren't JSON objects have no literal and stay."""
    lines = spark.read.text(path)
    literal = F.try_variant_get(F.try_parse_json("value"), "$.literal", "string")
    marked = lines.withColumn("_removed", F.coalesce(is_removed(literal), F.lit(False)))
    seen = Observation()
    kept = marked.observe(seen, F.count_if("_removed").alias("removed"), F.count_if(~F.col("_removed")).alias("kept")).where(~F.col("_removed"))
    write_staged(kept.select("value"), target or path, "text")
    return dict(seen.get)
