"""The chain of one source, from its manifest to the store, resumable after any stage.

Stages: describe (pending items D2 -> K1 -> description lines B3), mark (described flags B4) and ingest (E3, B1). A stage that
is through leaves a small commit record of the run; a run that is started again skips what is recorded. A stage that died
half-way is safe to repeat: items whose description is already in the output aren't sent again (A4), the manifest is replaced
by one rename, and the store knows the run's number. Scraping is not part of it: the manifest is the input.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.operators import enrich as en
from loopdex.operators.bucket_store import publish_text, read_text
from loopdex.operators.embedder import Embedder
from loopdex.operators.ingest_run import ingest
from loopdex.operators.store import exists
from loopdex.operators.worklist import mark_described, pack_manifests, pending_items
from loopdex.session import written
from loopdex.sources.captions import read_lines
from loopdex.sources.descriptions import done_keys
from loopdex.sources.manifests import manifest_items, read_manifests, write_sources

STAGES = ("describe", "mark", "ingest")
#: Output key -> manifest column of a description's own part.
BASE = {"id": "id", "url": "original_url", "attribution": "page_url", "original_description": "title"}


def _output(root: str, source: str) -> str:
    return f"{root}/{source}/descriptions.jsonl"


def _done(spark: SparkSession, root: str, source: str, items: DataFrame) -> DataFrame:
    """(source, id) of the descriptions that the output holds."""
    out = _output(root, source)
    lines = spark.read.text(out).withColumnRenamed("value", "line") if exists(spark, out) else spark.createDataFrame([], "line string")
    return done_keys(lines, "id").join(items.select("source", "id").distinct(), "id").select("source", "id")


def _describe(spark, root, source, describer, n, force, retries) -> dict:
    items = manifest_items(read_manifests(spark, root, source))
    todo = pending_items(items, _done(spark, root, source, items), n, force)
    todo = todo.withColumn("skip", F.lit(False))
    got = en.parse_response(en.describe(todo, describer, retries)).withColumn("removed", F.lit(False)).withColumn("status", en.status())
    lines = got.select("status", F.to_json(en.merge_open(en.base_object(BASE, ("attribution", "original_description")), F.col("parsed"))).alias("value"))
    lines = written(lines, "described-lines")
    lines.where("status = 'ok'").select("value").write.mode("append").text(_output(root, source))
    return {r["status"]: r["n"] for r in lines.groupBy("status").agg(F.count("*").alias("n")).collect()}


def _mark(spark, root, source) -> dict:
    items = manifest_items(read_manifests(spark, root, source))
    marked = mark_described(items, _done(spark, root, source, items))
    packed = pack_manifests(marked)
    rows = packed.select("source_dir", F.to_json(F.struct("source", "items")).alias("value"))
    write_sources(written(rows, "manifest"), root, "manifest.json")
    return {}


def pipeline_one(spark: SparkSession, root: str, source: str, run: int, describer: en.Describer, store: str, n: int = 0, force: bool = False,
                 retries: int = 1, embedder: Embedder | None = None, attribution: str | None = None) -> dict[str, dict]:
    """Describe, mark and ingest one source of ``root``; the counts of each stage. ``run`` numbers the runs of a source: a
    number that was used before goes on with that run, and changes nothing if it was through."""
    work = {
        "describe": lambda: _describe(spark, root, source, describer, n, force, retries),
        "mark": lambda: _mark(spark, root, source),
        "ingest": lambda: ingest(read_lines(spark, _output(root, source)), store, f"source:{source}", run, embedder, attribution) or {},
    }
    out = {}
    for stage in STAGES:
        record = f"{root}/_commits/{source}/{run:06d}-{stage}.json"
        if exists(spark, record):
            out[stage] = json.loads(read_text(spark, record))
            continue
        out[stage] = work[stage]()
        publish_text(spark, record, json.dumps(out[stage]))
    return out
