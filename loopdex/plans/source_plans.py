"""Plans over files: what the tables hold is first written in the sources' formats, then read, rewritten or ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.operators import bucket_store, store
from loopdex.operators import detail as dt
from loopdex.operators import enrich as en
from loopdex.operators.embedder import HashEmbedder
from loopdex.operators.ingest_run import embedded_lines
from loopdex.operators.ingest_run import ingest_summary as summary
from loopdex.operators.pipeline import pipeline_one as run_source
from loopdex.operators.worklist import pack_manifests
from loopdex.plans.common import DEFAULT_ATTRIBUTION, ELAPSED_SEC, ROUND_BATCH, duck_joined
from loopdex.plans.ingest_plans import _DESC
from loopdex.session import scratch
from loopdex.sources import fixtures as fx
from loopdex.sources import manifests as mf
from loopdex.sources.blobs import read_vector_blobs
from loopdex.streaming.ingest import stream_ingest as drain

Q: dict = {}
O: dict = {}


# ---------------------------------------------------------------- manifests and per-source files

def _manifests(spark: SparkSession, sf: str) -> str:
    """A folder of manifests of v_manifest_items, and one whose name says that it isn't a source."""
    items = fx.view(spark, sf, "v_manifest_items").where("source IS NOT NULL").withColumn("source_dir", F.col("source"))
    items = items.unionByName(items.withColumn("source_dir", F.concat(F.lit("_"), "source")))
    root = scratch(spark, "sources")
    mf.write_sources(pack_manifests(items).select("source_dir", F.to_json(F.struct("source", "items")).alias("value")), root, "manifest.json")
    return root


def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A3: every item of every manifest."""
    items = mf.manifest_items(mf.read_manifests(spark, _manifests(spark, sf)))
    return items.select("source_dir", "source", F.col("item_no").cast("long").alias("item_no"), "id", "original_url", "page_url", "format", "downloaded", "described")


O["manifest_scan"] = fx.with_views("""
SELECT source AS source_dir, source, row_number() OVER (PARTITION BY source ORDER BY item_no) - 1 AS item_no, id, original_url, page_url,
       format, downloaded, described
FROM v_manifest_items WHERE source IS NOT NULL""", "v_manifest_items")

_DIR = "lower(replace(p_brand, '#', '_'))"


def ingest_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The union of the description files of every brand's folder."""
    fx.register(spark, sf, ("v_description_json",))
    lines = spark.table("v_description_json").join(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.expr(_DIR).alias("source_dir")), "line_no")
    root = scratch(spark, "described")
    mf.write_sources(lines.select("source_dir", F.col("line").alias("value")), root, "descriptions.jsonl")
    got = mf.ingest_sources(spark, root)
    return got.where("reject IS NULL").select("source_dir", "id", "url", "literal", "action")


O["ingest_sources"] = fx.with_views(f"""
SELECT {_DIR} AS source_dir, id, url, literal, action FROM good JOIN part ON p_partkey = line_no""", "v_description_json", ctes=_DESC)


def vector_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """A5/K3: a binary file a vector, some without vectors, some cut short, read back and decoded."""
    folder = scratch(spark, "blobs")
    mkdirs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    mkdirs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(mkdirs)

    def write(batches):
        import struct

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                data = struct.pack("<QQ", 0 if i % 19 == 4 else 1, len(v)) + np.asarray(v, "<f4").tobytes()
                with system.open_output_stream(f"{path}/{i}.bin") as out:
                    out.write(data[:-5] if i % 17 == 3 else data[:11] if i % 23 == 5 else data)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    fx.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    got = read_vector_blobs(spark, folder, "*.bin")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return got.select("file", "status", "dim", F.size("embedding").cast("long").alias("n"), F.round(total, 4).alias("total"))


_STATUS = "CASE WHEN vec_id % 23 = 5 AND vec_id % 17 <> 3 THEN 'short_header' WHEN vec_id % 19 = 4 THEN 'empty' WHEN vec_id % 17 = 3 THEN 'short_data' ELSE 'ok' END"
O["vector_blobs"] = f"""
WITH b AS (SELECT *, {_STATUS} AS status FROM embeddings)
SELECT concat(CAST(vec_id AS VARCHAR), '.bin') AS file, status, CASE WHEN status <> 'short_header' THEN len(embedding) END AS dim,
       CASE WHEN status = 'ok' THEN len(embedding) END AS n, CASE WHEN status = 'ok' THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total
FROM b"""


# ---------------------------------------------------------------- rewriting and writing

def filter_store(spark: SparkSession, sf: str) -> DataFrame:
    """The description file rewritten without removed items, with the counts observed in that pass."""
    path = scratch(spark, "descriptions")
    fx.view(spark, sf, "v_description_json").select("line").write.text(path)
    counts = store.filter_store(spark, path)
    return spark.read.text(path).select(F.col("value").alias("line"), *[F.lit(counts[k]).cast("long").alias(k) for k in ("removed", "kept")])


O["filter_store"] = fx.with_views("""
SELECT line, count(*) FILTER (WHERE gone) OVER () AS removed, count(*) FILTER (WHERE NOT gone) OVER () AS kept
FROM (SELECT line, coalesce(contains(lower(json_extract_string(CASE WHEN json_valid(line) THEN line END, '$.literal')), 'content has been removed'), false) AS gone
      FROM v_description_json) QUALIFY NOT gone""", "v_description_json")


def write_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """A truncating write, then a resuming one, read back."""
    docs = fx.view(spark, sf, "v_docs").select("doc_id", "seq", "literal", "tags")
    path = scratch(spark, "written")
    store.write_descriptions(docs.limit(5), path, store.output_mode("captions"))
    store.write_descriptions(docs.where("seq % 2 = 0"), path, store.output_mode("captions", resume=False))
    store.write_descriptions(docs.where("seq % 2 <> 0"), path, store.output_mode("manifest", any_existing=True))
    back = spark.read.schema("doc_id string, seq bigint, literal string, tags array<string>").json(path)
    return back.select("doc_id", "seq", "literal", F.array_join("tags", "|").alias("tags"))


O["write_descriptions"] = fx.with_views(f"SELECT doc_id, seq, literal, {duck_joined('tags')} AS tags FROM v_docs", "v_docs")


def ensure_store(spark: SparkSession, sf: str) -> DataFrame:
    """A table created twice (the second time it exists already), filled and read."""
    path = scratch(spark, "ensured")
    name = "ensured_" + path.rsplit("-", 1)[1]
    for _ in range(2):
        store.ensure_store(spark, name, "doc_id string, seq bigint, literal string", path)
    fx.view(spark, sf, "v_docs").select("doc_id", F.col("seq").cast("long").alias("seq"), "literal").write.insertInto(name)
    store.ensure_store(spark, name, "doc_id string, seq bigint, literal string", path)
    return spark.table(name)


O["ensure_store"] = fx.with_views("SELECT doc_id, CAST(seq AS BIGINT) AS seq, literal FROM v_docs", "v_docs")


# ---------------------------------------------------------------- ingest

_DOC = f"""
doc AS (
  SELECT coalesce(nullif(id, ''), concat('gif_', substr(md5(url), 1, 16))) AS doc_id, line_no, url AS gif_url, literal,
         concat_ws('. ', coalesce(literal, ''), 'Source: ' || coalesce(source, ''), 'Mood: ' || coalesce(mood, ''),
                   'Actions: ' || action, 'Use case: ' || coalesce(context, ''),
                   'Tags: ' || coalesce(array_to_string(list_transform(tags, lambda x: coalesce(x, '')), ', '), '')) AS combined_text
  FROM good)"""


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The description lines arrive in three runs of one resumable stream; the last write of a document wins."""
    lines = fx.view(spark, sf, "v_description_json")
    root = scratch(spark, "stream-ingest")
    low, high = lines.agg(F.min("line_no"), F.max("line_no")).first()
    third = F.floor((F.col("line_no") - (low or 0)) * 3 / ((high or 0) - (low or 0) + 1))
    for i in range(3):
        run = lines.where(third == i).repartitionByRange("line_no").sortWithinPartitions("line_no")
        run.select("line").write.text(f"{root}/in/run-{i}")
        drain(spark, f"{root}/in/run-*", f"{root}/store", f"{root}/state")
    return bucket_store.read_store(spark, f"{root}/store").select("doc_id", "gif_url", "literal", "combined_text")


O["stream_ingest"] = fx.with_views("""
SELECT doc_id, gif_url, literal, combined_text FROM doc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) = 1""",
    "v_description_json", ctes=_DESC + "," + _DOC)


class FailsOn(HashEmbedder):
    """The default embedder, but texts with a word have no vector (a model that is down for some)."""

    def __init__(self, word: str):
        super().__init__()
        self.word = word

    def features(self, text):
        return F.when(text.contains(self.word), F.lit(None)).otherwise(super().features(text))


FAILING = "widget"


def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, skipped, embed failures, imported (distinct ids a batch of 50 documents), distinct documents and the rate
    for a run of eight seconds; counted beside the one write of the run."""
    good, counts = embedded_lines(fx.view(spark, sf, "v_description_json"), FailsOn(FAILING))
    return summary(good, counts, ROUND_BATCH, ELAPSED_SEC)


O["ingest_summary"] = fx.with_views(f"""
SELECT (SELECT count(*) FROM d1) AS lines, (SELECT count(*) FROM d1 WHERE reject IS NOT NULL) AS skipped,
       (SELECT count(*) FROM doc WHERE contains(combined_text, '{FAILING}')) AS embed_failed,
       count(DISTINCT (batch_no, doc_id)) AS imported, count(DISTINCT doc_id) AS distinct_docs,
       CAST(count(DISTINCT (batch_no, doc_id)) / {ELAPSED_SEC} AS DOUBLE) AS rate_per_sec
FROM (SELECT doc_id, floor((row_number() OVER (ORDER BY line_no) - 1) / {ROUND_BATCH}) AS batch_no FROM doc WHERE NOT contains(combined_text, '{FAILING}'))""",
    "v_description_json", ctes=_DESC + "," + _DOC)


def _recorded(pdf):
    """A recorded describer: what it says depends on the item's id alone."""
    def one(i):
        n = int(i.split("_")[1])
        return "not json" if n % 11 == 3 else '{"literal":"seen %d","mood":"calm","tags":["t%d"],"extra":{"n":%d}}' % (n, n % 5, n)

    return pdf["id"].map(one)


def pipeline_one(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain for the source that comes first by name, as the store holds it afterwards."""
    root = _manifests(spark, sf)
    source = fx.table(spark, sf, "documents").agg(F.min("source")).first()[0]
    run_source(spark, root, source, 1, _recorded, f"{root}/_store", attribution=DEFAULT_ATTRIBUTION)
    return bucket_store.read_store(spark, f"{root}/_store").select("doc_id", "gif_url", "original_description", "literal", "attribution", "combined_text")


O["pipeline_one"] = fx.with_views(f"""
SELECT id AS doc_id, original_url AS gif_url, '' AS original_description, 'seen ' || n AS literal, coalesce(page_url, '{DEFAULT_ATTRIBUTION}') AS attribution,
       'seen ' || n || '. Source: . Mood: calm. Actions: . Use case: . Tags: t' || (n % 5) AS combined_text
FROM (SELECT *, CAST(substr(id, 6) AS BIGINT) AS n FROM v_manifest_items)
WHERE source = (SELECT min(source) FROM documents) AND coalesce(downloaded, false) AND NOT coalesce(described, false) AND n % 11 <> 3""", "v_manifest_items")


# ---------------------------------------------------------------- open payloads

def _open(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.view(spark, sf, "v_open_payload")
    base = en.base_object({"id": "id", "url": "url", "attribution": "page_url", "original_description": "title"}, ("attribution", "original_description"))
    return en.parse_response(d, "payload").where("parse_ok").select("doc_id", en.merge_open(base, F.col("parsed")).alias("fields"))


def payload_open(spark: SparkSession, sf: str) -> DataFrame:
    """Every key of every merged payload with its value as JSON, unknown and nested ones too."""
    return _open(spark, sf).select("doc_id", F.explode("fields").alias("key", "v")).select("doc_id", "key", F.to_json("v").alias("value"))


_OPEN = """
o AS (SELECT *, json_object('id', id, 'url', url, 'attribution', coalesce(page_url, ''), 'original_description', coalesce(title, '')) AS base FROM v_open_payload),
merged AS (
  SELECT doc_id, key, json_extract(payload, '$.' || key) AS v FROM (SELECT doc_id, payload, unnest(json_keys(payload)) AS key FROM o)
  UNION ALL
  SELECT doc_id, key, json_extract(base, '$.' || key) FROM (SELECT doc_id, payload, base, unnest(json_keys(base)) AS key FROM o)
  WHERE NOT list_contains(json_keys(payload), key))"""
O["payload_open"] = fx.with_views("SELECT doc_id, key, CAST(v AS VARCHAR) AS value FROM merged", "v_open_payload", ctes=_OPEN)


def detail_open(spark: SparkSession, sf: str) -> DataFrame:
    """C22 on rows with unknown keys, nested values and timestamps."""
    return dt.detail_open(_open(spark, sf), "fields")


O["detail_open"] = fx.with_views("""
SELECT doc_id, section, position, CASE WHEN section = 4 THEN 'timestamp' ELSE key END AS field,
       CASE key WHEN 'tags' THEN 'Tags' WHEN 'literal' THEN 'Description' WHEN 'mood' THEN 'Mood' WHEN 'original_description' THEN 'Original Caption'
                WHEN 'description' THEN 'Original Caption' WHEN 'created_at' THEN 'Retrieved At' WHEN 'timestamp' THEN 'Retrieved At' WHEN 'url' THEN 'Url'
                WHEN 'video_URL' THEN 'Video URL' WHEN 'nested' THEN 'Nested' WHEN 'rating' THEN 'Rating' WHEN 'seen_by_all' THEN 'Seen By All' END AS label,
       CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$'
            WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(v AS JSON[]), lambda x: coalesce(x ->> '$', '')), ', ')
            ELSE CAST(v AS VARCHAR) END AS value
FROM (
  SELECT *, CASE WHEN key IN ('tags', 'literal', 'mood') THEN 1 WHEN key IN ('original_description', 'description') THEN 2
                 WHEN key IN ('created_at', 'timestamp') THEN 4 ELSE 3 END AS section,
         CASE key WHEN 'tags' THEN 0 WHEN 'literal' THEN 1 WHEN 'mood' THEN 3 WHEN 'original_description' THEN 0 WHEN 'description' THEN 1
                  WHEN 'created_at' THEN 0 WHEN 'timestamp' THEN 0
                  ELSE row_number() OVER (PARTITION BY doc_id, key IN ('tags', 'literal', 'mood', 'original_description', 'description', 'created_at', 'timestamp') ORDER BY key) - 1 END AS position,
         bool_or(key = 'original_description') OVER (PARTITION BY doc_id) AS original, bool_or(key = 'timestamp') OVER (PARTITION BY doc_id) AS stamped
  FROM merged WHERE key NOT IN ('id', 'attribution') AND json_type(v) <> 'NULL' AND v IS DISTINCT FROM '""'::JSON)
WHERE NOT (key = 'description' AND original) AND NOT (key = 'created_at' AND stamped)""", "v_open_payload", ctes=_OPEN)

Q.update({f.__name__: f for f in (
    manifest_scan, ingest_sources, vector_blobs, filter_store, write_descriptions, ensure_store, stream_ingest, ingest_summary, pipeline_one,
    payload_open, detail_open)})
