"""Media-plan, query-syntax, moderation, detail and sampling plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.functions import media as md
from loopdex.functions.moderation import has_blocked_tag, is_removed
from loopdex.functions.query import any_clause_matches, exclusion_clause_tokens, tag_tokens, with_parsed
from loopdex.functions.text import refine_query
from loopdex.operators import sample as sp
from loopdex.operators.detail import detail_fields as detail_op
from loopdex.operators.search import lookup_ids as lookup_op
from loopdex.plans.common import BLOCKED, PAGE_LIMIT, PAGE_OFFSET, SAMPLE_LIMIT, SAMPLE_SEED, joined, remap_update_id
from loopdex.plans.oracle_search import parse_sql, tok
from loopdex.sources import fixtures as fx

Q: dict = {}
O: dict = {}


def _media(spark, sf):
    return fx.view(spark, sf, "v_media")


def frame_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _media(spark, sf).select("media_id", joined(md.frame_plan("n_frames"), ",").alias("frames"))


_FRAMES = """CASE WHEN n_frames <= 5 THEN (CASE WHEN n_frames > 0 THEN range(0, n_frames) ELSE [] END)
     ELSE list_transform(range(0, 5), lambda i: CAST(round_even(i * (n_frames - 1) / 4.0, 0) AS INTEGER)) END"""
O["frame_plan"] = fx.with_views(f"SELECT media_id, array_to_string({_FRAMES}, ',') AS frames FROM v_media", "v_media")


def resize_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _media(spark, sf).select("media_id", md.resize_plan("w", "h").alias("r")).select("media_id", "r.w", "r.h")


O["resize_plan"] = fx.with_views("""
SELECT media_id,
       CASE WHEN greatest(w, h) > 512 THEN CAST(round_even(w * (512.0 / greatest(w, h)), 0) AS INTEGER) ELSE w END AS w,
       CASE WHEN greatest(w, h) > 512 THEN CAST(round_even(h * (512.0 / greatest(w, h)), 0) AS INTEGER) ELSE h END AS h
FROM v_media""", "v_media")

_DUR = """CASE WHEN (CASE WHEN coalesce(duration, 0) = 0 THEN
                    (CASE WHEN nb_frames > 0 AND rate_num > 0 THEN nb_frames * rate_den / rate_num ELSE 0.0 END)
                  ELSE duration END) <= 0 THEN 1.0
            ELSE (CASE WHEN coalesce(duration, 0) = 0 THEN
                    (CASE WHEN nb_frames > 0 AND rate_num > 0 THEN nb_frames * rate_den / rate_num ELSE 0.0 END)
                  ELSE duration END) END"""


def video_plan(spark: SparkSession, sf: str) -> DataFrame:
    m = _media(spark, sf)
    return m.select("media_id", md.video_duration("duration", "nb_frames", "rate_num", "rate_den").alias("duration"),
                    joined(md.video_plan("duration", "nb_frames", "rate_num", "rate_den"), ",").alias("timestamps"))


_TS = "list_transform(range(0, 5), lambda i: printf('%.3f', CASE WHEN i = 4 THEN greatest(0.0, d - 0.01) ELSE i * d / 4.0 END))"
O["video_plan"] = fx.with_views(f"""
SELECT media_id, d AS duration, array_to_string({_TS}, ',') AS timestamps
FROM (SELECT media_id, CAST({_DUR} AS DOUBLE) AS d FROM v_media)""", "v_media")


def media_plan(spark: SparkSession, sf: str) -> DataFrame:
    """K4: sampler per format and its plan (timestamps for video, frame indices otherwise)."""
    m = _media(spark, sf)
    s = md.sampler_for("format")
    plan = F.when(s == "video", joined(md.video_plan("duration", "nb_frames", "rate_num", "rate_den"), ",")) \
        .otherwise(joined(md.frame_plan("n_frames"), ","))
    return m.select("media_id", s.alias("sampler"), plan.alias("plan"), md.resize_plan("w", "h").alias("r")).select(
        "media_id", "sampler", "plan", "r.w", "r.h")


O["media_plan"] = fx.with_views(f"""
SELECT media_id, CASE WHEN coalesce(format, 'gif') IN ('mp4', 'webm') THEN 'video' ELSE 'frames' END AS sampler,
       CASE WHEN coalesce(format, 'gif') IN ('mp4', 'webm')
            THEN array_to_string(list_transform(range(0, 5), lambda i: printf('%.3f', CASE WHEN i = 4 THEN greatest(0.0, ({_DUR}) - 0.01) ELSE i * ({_DUR}) / 4.0 END)), ',')
            ELSE array_to_string({_FRAMES}, ',') END AS plan,
       CASE WHEN greatest(w, h) > 512 THEN CAST(round_even(w * (512.0 / greatest(w, h)), 0) AS INTEGER) ELSE w END AS w,
       CASE WHEN greatest(w, h) > 512 THEN CAST(round_even(h * (512.0 / greatest(w, h)), 0) AS INTEGER) ELSE h END AS h
FROM v_media""", "v_media")


# ---------------------------------------------------------------- query syntax

def _queries(spark, sf):
    return with_parsed(fx.view(spark, sf, "v_query_texts"))


def query_parse(spark: SparkSession, sf: str) -> DataFrame:
    q = _queries(spark, sf)
    return q.select(F.col("query_id").cast("long").alias("query_id"), joined("phrases").alias("phrases"), "loose",
                    joined("tags").alias("tags"), joined("neg_tags").alias("neg_tags"))


O["query_parse"] = fx.with_views(f"""
SELECT CAST(query_id AS BIGINT) AS query_id, array_to_string(phrases, '|') AS phrases, loose,
       array_to_string(tags, '|') AS tags, array_to_string(neg_tags, '|') AS neg_tags FROM pq""", "v_query_texts", ctes=parse_sql("v_query_texts"))

_MODE = ("CASE WHEN loose <> '' THEN 'hybrid' WHEN len(phrases) > 0 THEN 'text' WHEN len(tags) > 0 THEN 'tags' ELSE 'all' END")


def query_mode(spark: SparkSession, sf: str) -> DataFrame:
    q = _queries(spark, sf)
    return q.select(F.col("query_id").cast("long").alias("query_id"), "mode", "tag_role", "use_vector", "has_text")


O["query_mode"] = fx.with_views(f"""
SELECT CAST(query_id AS BIGINT) AS query_id, {_MODE} AS mode,
       CASE WHEN len(tags) = 0 THEN 'none' WHEN loose <> '' OR len(phrases) > 0 THEN 'filter' ELSE 'primary' END AS tag_role,
       loose <> '' AS use_vector, loose <> '' OR len(phrases) > 0 AS has_text FROM pq""", "v_query_texts", ctes=parse_sql("v_query_texts"))


def query_refine(spark: SparkSession, sf: str) -> DataFrame:
    """Drill-down: each query refined with the last tag of its paired document (seq = vec_id)."""
    fx.register(spark, sf, ("v_query_texts", "v_docs"))
    q = spark.table("v_query_texts")
    d = spark.table("v_docs").select("seq", F.element_at("tags", -1).alias("tag"))
    j = q.join(d, q.vec_id == d.seq).where(F.col("tag").isNotNull())
    return j.select(F.col("query_id").cast("long").alias("query_id"), refine_query("raw", "tag").alias("refined"))


O["query_refine"] = fx.with_views("""
SELECT CAST(q.query_id AS BIGINT) AS query_id,
       CASE WHEN coalesce(q.raw, '') = '' THEN t ELSE concat(q.raw, ' ', t) END AS refined
FROM v_query_texts q JOIN (SELECT seq, CASE WHEN contains(tags[-1], ' ') THEN concat('tag:"', tags[-1], '"') ELSE concat('tag:', tags[-1]) END AS t
                       FROM v_docs WHERE tags[-1] IS NOT NULL) d ON d.seq = q.vec_id""", "v_query_texts", "v_docs")


# ---------------------------------------------------------------- moderation / lookup / detail

def _docs(spark, sf):
    d = fx.view(spark, sf, "v_docs")
    blocked = F.array(*[exclusion_clause_tokens(F.lit(t)) for t in BLOCKED])
    return d.withColumn("excluded", any_clause_matches(tag_tokens("tags"), blocked))


def moderate(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.view(spark, sf, "v_docs")
    return d.select("doc_id", is_removed("literal", "combined_text").alias("removed"), has_blocked_tag("tags", BLOCKED).alias("blocked"))


_REMOVED = ("(coalesce(contains(lower(literal), 'content has been removed'), false) "
            "OR coalesce(contains(lower(combined_text), 'content has been removed'), false))")
_BLOCKED = "coalesce(len(list_filter(tags, lambda x: lower(x) = 'nsfw')) > 0, false)"
O["moderate"] = fx.with_views(f"SELECT doc_id, {_REMOVED} AS removed, {_BLOCKED} AS blocked FROM v_docs", "v_docs")


def lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup of the update-key id table plus every removed document's id."""
    fx.register(spark, sf, ("v_docs", "v_updates"))
    ids = spark.sql(f"SELECT {remap_update_id('seq')} AS doc_id FROM v_updates UNION ALL "
                    "SELECT doc_id FROM v_docs WHERE lower(literal) LIKE '%content has been removed%'")
    return lookup_op(spark.table("v_docs"), ids)


O["lookup_ids"] = fx.with_views(f"""
SELECT doc_id, 0.0::DOUBLE AS score, coalesce(gif_url, '') AS gif_url, coalesce(original_description, combined_text, '') AS description
FROM v_docs
WHERE doc_id IN (SELECT {remap_update_id('seq')} FROM v_updates UNION ALL
                 SELECT doc_id FROM v_docs WHERE lower(literal) LIKE '%content has been removed%')
  AND NOT {_REMOVED}""", "v_docs", "v_updates")


def detail_fields(spark: SparkSession, sf: str) -> DataFrame:
    return detail_op(fx.view(spark, sf, "v_docs"))


O["detail_fields"] = fx.with_views("""
SELECT doc_id, 1 AS section, 0 AS position, 'tags' AS field, 'Tags' AS label, array_to_string(list_transform(tags, lambda x: coalesce(x, '')), ', ') AS value FROM v_docs WHERE tags IS NOT NULL
UNION ALL SELECT doc_id, 1, 1, 'literal', 'Description', literal FROM v_docs WHERE literal IS NOT NULL AND literal <> ''
UNION ALL SELECT doc_id, 1, 2, 'source', 'Source', source FROM v_docs WHERE source IS NOT NULL AND source <> ''
UNION ALL SELECT doc_id, 1, 3, 'mood', 'Mood', mood FROM v_docs WHERE mood IS NOT NULL AND mood <> ''
UNION ALL SELECT doc_id, 2, 0, 'original_description', 'Original Caption', original_description FROM v_docs
          WHERE original_description IS NOT NULL AND original_description <> ''""", "v_docs")


# ---------------------------------------------------------------- listing and sampling

def page_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sp.page_scan(_docs(spark, sf), PAGE_LIMIT, PAGE_OFFSET).select("doc_id", "seq")


_EXCL = f"len(list_filter(coalesce(list_transform(tags, lambda t: {tok('t')}), []), lambda tt: contains(' ' || array_to_string(tt, ' ') || ' ', ' nsfw '))) > 0"
O["page_scan"] = fx.with_views(f"""
SELECT doc_id, seq FROM v_docs WHERE NOT ({_EXCL}) ORDER BY seq, doc_id LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}""", "v_docs")


def sample_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return sp.sample_uniform(_docs(spark, sf), SAMPLE_LIMIT, SAMPLE_SEED, BLOCKED).select("doc_id", "seq")


O["sample_uniform"] = fx.with_views(f"""
SELECT doc_id, seq FROM v_docs WHERE NOT ({_EXCL}) AND NOT {_REMOVED} AND NOT {_BLOCKED}
ORDER BY md5(concat(doc_id, '{SAMPLE_SEED}')), doc_id LIMIT {SAMPLE_LIMIT}""", "v_docs")


def _offsets(spark, total_col, limit: int, seed: int):
    """Deterministic window offsets from T (same formula as the oracle): m windows at
    (i*7919 + seed*104729) mod max(1, T-b); b = min(2*limit, T)."""
    b = F.least(F.lit(2 * limit), total_col)
    m = F.least(F.lit(5), F.ceil(total_col / b))
    base = spark.range(5).select(F.col("id").cast("int").alias("window_no"))
    return base.where(F.col("window_no") < m).select(
        "window_no", F.pmod(F.col("window_no") * 7919 + F.lit(seed * 104729), F.greatest(F.lit(1), total_col - b)).cast("long").alias("off"),
        b.cast("long").alias("b"))


def sample_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    total = d.where(~F.col("excluded")).agg(F.count(F.lit(1))).scalar()
    offs = _offsets(spark, total, SAMPLE_LIMIT, SAMPLE_SEED)
    return sp.sample_windows(d, offs, SAMPLE_LIMIT, SAMPLE_SEED, BLOCKED).select("doc_id", "seq")


O["sample_windows"] = fx.with_views(f"""
SELECT doc_id, seq FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY o.window_no, p.pos) AS dup
  FROM (SELECT *, row_number() OVER (ORDER BY seq) AS pos FROM v_docs WHERE NOT ({_EXCL})) p
  JOIN (SELECT window_no, (window_no * 7919 + {SAMPLE_SEED * 104729}) % greatest(1, t - b) AS off
        FROM (SELECT t, least({2 * SAMPLE_LIMIT}, t) AS b FROM (SELECT count(*) AS t FROM v_docs WHERE NOT ({_EXCL}))),
             range(0, 5) r(window_no)
        WHERE window_no < least(5, ceil(t / b))) o
    ON p.pos > o.off AND p.pos <= o.off + least({2 * SAMPLE_LIMIT}, (SELECT count(*) FROM v_docs WHERE NOT ({_EXCL})))
) WHERE dup = 1 AND NOT {_REMOVED} AND NOT {_BLOCKED}
ORDER BY md5(concat(doc_id, '{SAMPLE_SEED}')), doc_id LIMIT {SAMPLE_LIMIT}""", "v_docs")

Q.update({
    "frame_plan": frame_plan, "resize_plan": resize_plan, "video_plan": video_plan, "media_plan": media_plan,
    "query_parse": query_parse, "query_mode": query_mode, "query_refine": query_refine,
    "moderate": moderate, "lookup_ids": lookup_ids, "detail_fields": detail_fields,
    "page_scan": page_scan, "sample_uniform": sample_uniform, "sample_windows": sample_windows,
})
