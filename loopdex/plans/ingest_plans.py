"""Ingest plans: captions, description records, flattening, upsert/delete, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.functions.moderation import is_removed
from loopdex.operators import store
from loopdex.operators.reports import filter_summary
from loopdex.plans.common import (DEFAULT_ATTRIBUTION, HEAD_LIMIT, ROUND_BATCH, ROUND_LIMIT, duck_joined, joined,
                                  remap_update_id)
from loopdex.sources import captions as cap
from loopdex.sources import descriptions as desc
from loopdex.sources import fixtures as fx
from loopdex.streaming.ingest import to_docs

Q: dict = {}
O: dict = {}


def _lines(spark, sf):
    return fx.view(spark, sf, "v_caption_lines")


def caption_parse(spark: SparkSession, sf: str) -> DataFrame:
    return cap.parse_captions(_lines(spark, sf), "raw").where("valid").select("line_no", "url", "description")


def caption_parse_strip(spark: SparkSession, sf: str) -> DataFrame:
    return cap.parse_captions(_lines(spark, sf), "strip").where("valid").select("line_no", "url", "description")


_SPLIT = """
  SELECT line_no, substr(l, 1, strpos(l, chr(9)) - 1) AS url, substr(l, strpos(l, chr(9)) + 1) AS description
  FROM (SELECT line_no, {expr} AS l FROM v_caption_lines) WHERE strpos(l, chr(9)) > 0"""
O["caption_parse"] = fx.with_views(_SPLIT.format(expr="line"), "v_caption_lines")
O["caption_parse_strip"] = fx.with_views(_SPLIT.format(expr="regexp_replace(line, '^\\s+|\\s+$', '', 'g')"), "v_caption_lines")


def cdn_rewrite_doc_id(spark: SparkSession, sf: str) -> DataFrame:
    return cap.caption_docs(cap.parse_captions(_lines(spark, sf))).select("line_no", "gif_url", "tumblr_id", "doc_id")


_REWRITE = "replace(replace(replace({u}, '38.media.tumblr.com', '64.media.tumblr.com'), '33.media.tumblr.com', '64.media.tumblr.com'), '31.media.tumblr.com', '64.media.tumblr.com')"
_CAPS = f"""caps AS (
  SELECT line_no, {_REWRITE.format(u='url')} AS gif_url, description FROM (
  {_SPLIT.format(expr='line')}))"""
O["cdn_rewrite_doc_id"] = fx.with_views("""
SELECT line_no, gif_url, regexp_extract(gif_url, 'tumblr_([a-zA-Z0-9]+)', 1) AS tumblr_id,
       concat('gif_', substr(md5(gif_url), 1, 16)) AS doc_id FROM caps""", "v_caption_lines", ctes=_CAPS)


def caption_head_limit(spark: SparkSession, sf: str) -> DataFrame:
    return cap.head_limit(cap.parse_captions(_lines(spark, sf)), HEAD_LIMIT).select("line_no", "url", "description")


O["caption_head_limit"] = fx.with_views(_SPLIT.format(expr="line") + f" ORDER BY line_no LIMIT {HEAD_LIMIT}", "v_caption_lines")


def batch_rounded_limit(spark: SparkSession, sf: str) -> DataFrame:
    return cap.batch_rounded_limit(cap.parse_captions(_lines(spark, sf)), ROUND_LIMIT, ROUND_BATCH).select("line_no", "url")


_EDGE = -(-ROUND_LIMIT // ROUND_BATCH) * ROUND_BATCH
O["batch_rounded_limit"] = fx.with_views(
    f"SELECT line_no, url FROM ({_SPLIT.format(expr='line')}) ORDER BY line_no LIMIT {_EDGE}", "v_caption_lines")


# ---------------------------------------------------------------- description records

def _parsed(spark, sf):
    return desc.parse_descriptions(fx.view(spark, sf, "v_description_json"))


def description_parse(spark: SparkSession, sf: str) -> DataFrame:
    g = desc.good(_parsed(spark, sf))
    return g.select("line_no", "id", "url", "attribution", "original_description", "literal", "source", "mood", "action",
                    "context", joined("tags").alias("tags"))


def description_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return desc.quarantine(_parsed(spark, sf))


_STR_FIELDS = ("id", "url", "attribution", "original_description", "literal", "source", "mood", "context")
_TYPE_CHECKS = " ".join(
    f"WHEN json_type(line, '$.{f}') IS NOT NULL AND json_type(line, '$.{f}') NOT IN ('VARCHAR', 'NULL') THEN 'type:{f}'"
    for f in _STR_FIELDS)
_DESC = f"""
d0 AS (SELECT line_no, line, json_valid(line) AS ok FROM v_description_json),
d1 AS (
  SELECT line_no, line,
         CASE WHEN NOT ok THEN 'json'
              WHEN json_type(line) NOT IN ('OBJECT', 'NULL') THEN 'not_object'
              WHEN json_type(line, '$.tags') IS NOT NULL AND json_type(line, '$.tags') <> 'NULL' AND (json_type(line, '$.tags') <> 'ARRAY'
                   OR len(list_filter(CAST(json_extract(line, '$.tags[*]') AS JSON[]), lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) > 0)
                THEN 'type:tags'
              {_TYPE_CHECKS}
         END AS reject
  FROM d0),
good AS (
  SELECT line_no,
         {', '.join(f"json_extract_string(line, '$.{f}') AS {f}" for f in _STR_FIELDS)},
         CASE WHEN json_type(line, '$.action') = 'VARCHAR' THEN json_extract_string(line, '$.action')
              WHEN json_type(line, '$.action') = 'ARRAY'
                   AND len(list_filter(CAST(json_extract(line, '$.action[*]') AS JSON[]), lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) = 0
                THEN array_to_string(list_transform(CAST(json_extract(line, '$.action[*]') AS JSON[]),
                                                    lambda x: coalesce(json_extract_string(x, '$'), '')), ', ')
              ELSE '' END AS action,
         CAST(json_extract_string(line, '$.tags[*]') AS VARCHAR[]) AS tags,
         json_type(line, '$.tags') AS tags_kind
  FROM d1 WHERE reject IS NULL)"""
O["description_parse"] = fx.with_views(f"""
SELECT line_no, id, url, attribution, original_description, literal, source, mood, action, context,
       CASE WHEN tags_kind = 'ARRAY' THEN {duck_joined('tags')} END AS tags
FROM good""", "v_description_json", ctes=_DESC)
O["description_quarantine"] = fx.with_views("SELECT line_no, reject FROM d1 WHERE reject IS NOT NULL", "v_description_json", ctes=_DESC)


def doc_flatten(spark: SparkSession, sf: str) -> DataFrame:
    d = to_docs(desc.good(_parsed(spark, sf)), DEFAULT_ATTRIBUTION)
    return d.select("doc_id", "seq", "gif_url", "attribution", "combined_text")


O["doc_flatten"] = fx.with_views(f"""
SELECT coalesce(nullif(id, ''), concat('gif_', substr(md5(url), 1, 16))) AS doc_id, line_no AS seq, url AS gif_url,
       coalesce(nullif(attribution, ''), '{DEFAULT_ATTRIBUTION}') AS attribution,
       concat_ws('. ', coalesce(literal, ''), 'Source: ' || coalesce(source, ''), 'Mood: ' || coalesce(mood, ''),
                 'Actions: ' || action, 'Use case: ' || coalesce(context, ''),
                 'Tags: ' || coalesce(array_to_string(list_transform(tags, lambda x: coalesce(x, '')), ', '), '')) AS combined_text
FROM good""", "v_description_json", ctes=_DESC)


def filter_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    g = desc.good(_parsed(spark, sf))
    return filter_summary(g, ~is_removed("literal"))


O["filter_summary"] = fx.with_views("""
SELECT count(*) FILTER (WHERE coalesce(contains(lower(literal), 'content has been removed'), false)) AS removed,
       count(*) FILTER (WHERE NOT coalesce(contains(lower(literal), 'content has been removed'), false)) AS kept
FROM good""", "v_description_json", ctes=_DESC)


# ---------------------------------------------------------------- store mutations

def _store_and_updates(spark, sf):
    fx.register(spark, sf, ("v_docs", "v_updates"))
    st = spark.table("v_docs").select("doc_id", "seq", F.col("mood").alias("value"))
    up = spark.sql(f"SELECT {remap_update_id('seq')} AS doc_id, seq, value FROM v_updates")
    return st, up


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    st, up = _store_and_updates(spark, sf)
    return store.upsert(st, up).select("doc_id", "seq", "value")


O["upsert_latest"] = fx.with_views(f"""
SELECT doc_id, seq, value FROM v_docs_store WHERE doc_id NOT IN (SELECT doc_id FROM upd)
UNION ALL
SELECT doc_id, max(seq) AS seq, arg_max(value, seq) AS value FROM upd GROUP BY doc_id""",
    "v_docs", "v_updates",
    ctes=f"v_docs_store AS (SELECT doc_id, seq, mood AS value FROM v_docs), "
         f"upd AS (SELECT {remap_update_id('seq')} AS doc_id, seq, value FROM v_updates)")


def delete_ids(spark: SparkSession, sf: str) -> DataFrame:
    st, up = _store_and_updates(spark, sf)
    return store.delete(st, up.select("doc_id")).select("doc_id", "seq")


O["delete_ids"] = fx.with_views(f"""
SELECT doc_id, seq FROM v_docs WHERE doc_id NOT IN (SELECT {remap_update_id('seq')} FROM v_updates)""", "v_docs", "v_updates")

Q.update({
    "caption_parse": caption_parse, "caption_parse_strip": caption_parse_strip, "cdn_rewrite_doc_id": cdn_rewrite_doc_id,
    "caption_head_limit": caption_head_limit, "batch_rounded_limit": batch_rounded_limit,
    "description_parse": description_parse, "description_quarantine": description_quarantine, "doc_flatten": doc_flatten,
    "filter_summary": filter_summary_q, "upsert_latest": upsert_latest, "delete_ids": delete_ids,
})
