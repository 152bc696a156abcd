"""An incremental document store: rows in hash buckets, a batch rewrites only the buckets it touches.

A store folder has ``data/<version>/bucket=<k>/`` Parquet folders, each written once and never changed, and
``commits/<number>.json``, the newest of which says which version holds each bucket, the row schema and the last batch of
every writer. A batch reads the buckets of its keys, writes them anew as one version, and is then committed by renaming one
small file into place. So readers see whole batches only, a run that dies before the commit leaves the store as it was,
and a batch that is already recorded is a no-op when it is played again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loopdex.operators.store import delete, exists, upsert

BUCKETS = 64


@dataclass
class Commit:
    """What a commit file says: versions maps buckets to data folders, batches writers to their last batch number."""

    number: int = -1
    buckets: int = BUCKETS
    schema: str | None = None
    versions: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then rename it; an existing file is an error."""
    at, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)
        raise OSError(f"{path} was written by another run")


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def last_commit(spark: SparkSession, root: str) -> Commit:
    if not exists(spark, f"{root}/commits"):
        return Commit()
    at, fs = _fs(spark, f"{root}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
    return Commit(**json.loads(read_text(spark, f"{root}/commits/{max(numbers):010d}.json"))) if numbers else Commit()


def _folders(root: str, commit: Commit, buckets: list[int] | None = None) -> list[str]:
    wanted = commit.versions if buckets is None else {str(b) for b in buckets} & set(commit.versions)
    return [f"{root}/data/{commit.versions[b]}/bucket={b}" for b in sorted(wanted, key=int)]


def _rows(spark: SparkSession, root: str, commit: Commit, buckets: list[int] | None = None) -> DataFrame | None:
    if commit.schema is None:
        return None
    schema = StructType.fromJson(json.loads(commit.schema))
    folders = _folders(root, commit, buckets)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the last committed batch; a store that no batch was written to is an error."""
    rows = _rows(spark, root, last_commit(spark, root))
    if rows is None:
        raise FileNotFoundError(f"there is no store at {root}")
    return rows


def _bucket(key: str, n: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def apply_batch(spark: SparkSession, root: str, updates: DataFrame, writer: str, batch: int, key: str = "doc_id", order: str = "seq",
                remove: DataFrame | None = None, buckets: int = BUCKETS) -> dict | None:
    """Upsert updates (the last row a key by ``order`` wins, as in ``store.upsert``), after removing the keys of ``remove``.

    Batches of one writer are numbered upwards; one that isn't above the writer's last is a no-op (None). Otherwise the
    counts of the run, observed in its one write: rows written, and buckets touched of those there are."""
    now = last_commit(spark, root)
    if batch <= now.batches.get(writer, -1):
        return None
    n = now.buckets if now.number >= 0 else buckets
    keys = updates.select(_bucket(key, n).alias("b"))
    if remove is not None:
        keys = keys.unionByName(remove.select(_bucket(key, n).alias("b")))
    touched = sorted(r["b"] for r in keys.distinct().collect())  # at most the number of buckets
    old = _rows(spark, root, now, touched)
    base = updates.limit(0) if old is None else old
    new = upsert(base if remove is None else delete(base, remove, key), updates, key, order)
    version, counts = uuid.uuid4().hex, {"rows": 0}
    if touched:
        seen = Observation()
        dealt = new.withColumn("bucket", _bucket(key, n)).repartition("bucket")
        dealt.observe(seen, F.count("*").alias("rows")).write.partitionBy("bucket").parquet(f"{root}/data/{version}")
        counts = dict(seen.get)
    present = {int(s) for s in _buckets_in(spark, f"{root}/data/{version}")}
    versions = {b: v for b, v in now.versions.items() if int(b) not in set(touched)} | {str(b): version for b in present}
    after = Commit(now.number + 1, n, new.schema.json(), versions, {**now.batches, writer: batch})
    publish_text(spark, f"{root}/commits/{after.number:010d}.json", json.dumps(after.__dict__))
    return {**counts, "touched": len(touched), "buckets": n}


def _buckets_in(spark: SparkSession, folder: str) -> list[str]:
    if not exists(spark, folder):
        return []
    at, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return [x.split("=", 1)[1] for x in names if x.startswith("bucket=")]


def clean(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete data that none of the last ``keep`` commits names, and older commits; the number of folders deleted. Only for
    a store that nobody reads an older commit of."""
    at, fs = _fs(spark, f"{root}/commits")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
    live = {v for n in names[-keep:] for v in json.loads(read_text(spark, f"{root}/commits/{n}"))["versions"].values()}
    for n in names[:-keep]:
        fs.delete(_fs(spark, f"{root}/commits/{n}")[0], False)
    data, _ = _fs(spark, f"{root}/data")
    dead = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in live]
    for path in dead:
        fs.delete(path, True)
    return len(dead)
