"""Enrichment plans: work selection, describe (recorded), payload rules, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.operators import enrich as en
from loopdex.operators import reports as rp
from loopdex.operators import worklist as wl
from loopdex.plans.common import ELAPSED_SEC, PER_SOURCE_LIMIT, duck_joined, joined
from loopdex.sources import captions as cap
from loopdex.sources import fixtures as fx

Q: dict = {}
O: dict = {}

_REWRITE = ("replace(replace(replace({u}, '38.media.tumblr.com', '64.media.tumblr.com'), '33.media.tumblr.com', "
            "'64.media.tumblr.com'), '31.media.tumblr.com', '64.media.tumblr.com')")
_CAPS = f"""caps AS (
  SELECT line_no, {_REWRITE.format(u="substr(line, 1, strpos(line, chr(9)) - 1)")} AS gif_url
  FROM v_caption_lines WHERE strpos(line, chr(9)) > 0)"""


def pending_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions not yet described; done = URLs of captions whose document is labelled quality 1."""
    caps = cap.caption_docs(cap.parse_captions(fx.view(spark, sf, "v_caption_lines")))
    labels = fx.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("line_no"))
    done = caps.join(labels, "line_no", "left_semi").select("gif_url")
    return wl.pending_captions(caps, done).select("line_no", "gif_url")


O["pending_captions"] = fx.with_views("""
SELECT line_no, gif_url FROM caps
WHERE gif_url NOT IN (SELECT c.gif_url FROM caps c JOIN labels l ON l.doc_id = c.line_no WHERE l.quality = 1)""",
    "v_caption_lines", ctes=_CAPS)


def _items(spark, sf):
    return fx.view(spark, sf, "v_manifest_items")


def first_n_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return wl.first_n_per_source(_items(spark, sf), PER_SOURCE_LIMIT).select("source", "item_no", "id")


_NEED = "coalesce(downloaded, false) AND NOT coalesce(described, false)"
_FIRSTN = f"""firstn AS (
  SELECT source, item_no, id FROM v_manifest_items WHERE {_NEED}
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY item_no) <= {PER_SOURCE_LIMIT})"""
O["first_n_per_source"] = fx.with_views("SELECT * FROM firstn", "v_manifest_items", ctes=_FIRSTN)


def pending_items(spark: SparkSession, sf: str) -> DataFrame:
    """done = ids of items whose document is labelled toxic (already in the output)."""
    done = fx.table(spark, sf, "labels").where("toxic = 1").join(fx.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        "source", F.concat(F.lit("item_"), F.col("doc_id").cast("string")).alias("id"))
    return wl.pending_items(_items(spark, sf), done, PER_SOURCE_LIMIT).select("source", "item_no", "id")


O["pending_items"] = fx.with_views("""
SELECT * FROM firstn WHERE id NOT IN (SELECT concat('item_', CAST(doc_id AS STRING)) FROM labels WHERE toxic = 1)""",
    "v_manifest_items", ctes=_FIRSTN)


# ---------------------------------------------------------------- describe (recorded)

def _described(spark, sf):
    p = fx.view(spark, sf, "v_payload").withColumn("skip", en.fetch_removed())
    d = en.describe(p, en.recorded_describer("payload"), retries=1)
    d = en.parse_response(d).withColumn("removed", en.fetch_removed())
    return d.withColumn("status", en.status())


_PAY = """
pay AS (
  SELECT *, regexp_replace(payload, '^\\s+|\\s+$', '', 'g') AS t0 FROM v_payload),
pay2 AS (
  SELECT *, CASE WHEN starts_with(t0, '```') THEN
              CASE WHEN len(string_split(t0, chr(10))) >= 3
                   THEN array_to_string(list_slice(string_split(t0, chr(10)), 2, len(string_split(t0, chr(10))) - 1), chr(10))
                   ELSE '' END
            ELSE t0 END AS cleaned
  FROM pay),
pay25 AS (SELECT *, CASE WHEN json_valid(cleaned) THEN cleaned END AS j FROM pay2),
pay3 AS (
  SELECT *, j IS NOT NULL AS parses,
         coalesce(json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0, false) AS parse_ok,
         fetch_error IS NOT NULL OR coalesce(contains(final_url, 'media_violation'), false) AS removed
  FROM pay25),
st AS (
  SELECT *, CASE WHEN removed THEN 'removed' WHEN parse_ok THEN 'ok' ELSE 'failed' END AS status,
         CASE WHEN removed THEN 0 WHEN parses THEN 1 ELSE 2 END AS attempts
  FROM pay3)"""


def payload_clean_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = en.parse_response(fx.view(spark, sf, "v_payload"), "payload")
    return d.select("doc_id", "cleaned", "parse_ok")


O["payload_clean_parse"] = fx.with_views("SELECT doc_id, cleaned, parse_ok FROM st", "v_payload", ctes=_PAY)


def payload_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = en.parse_response(fx.view(spark, sf, "v_payload"), "payload").where("parse_ok")
    m = en.merge_payload(d, {"url": "url", "original_description": "original_description"})
    return m.select("doc_id", "url", "original_description", "literal", "action", joined("tags").alias("tags"))


O["payload_merge"] = fx.with_views(f"""
SELECT doc_id, coalesce(json_extract_string(j, '$.url'), url) AS url,
       coalesce(json_extract_string(j, '$.original_description'), original_description) AS original_description,
       json_extract_string(j, '$.literal') AS literal,
       CASE WHEN json_type(j, '$.action') = 'VARCHAR' THEN json_extract_string(j, '$.action') ELSE '' END AS action,
       CASE WHEN json_type(j, '$.tags') = 'ARRAY' THEN {duck_joined("CAST(json_extract_string(j, '$.tags[*]') AS VARCHAR[])")} END AS tags
FROM st WHERE parse_ok""", "v_payload", ctes=_PAY)


def describe_recorded(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf).select("doc_id", "status", "attempts")


O["describe_recorded"] = fx.with_views("SELECT doc_id, status, attempts FROM st", "v_payload", ctes=_PAY)


def fetch_status(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, "v_payload").select("doc_id", en.fetch_removed().alias("removed"))


O["fetch_status"] = fx.with_views("SELECT doc_id, removed FROM st", "v_payload", ctes=_PAY)


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rp.run_summary(_described(spark, sf), ELAPSED_SEC)


O["run_summary"] = fx.with_views(f"""
SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'removed') AS removed, count(*) AS done, CAST(count(*) / {ELAPSED_SEC} AS DOUBLE) AS rate_per_sec
FROM st""", "v_payload", ctes=_PAY)


def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    s = rp.run_summary(_described(spark, sf))
    return s.select("ok", rp.cost_estimate("ok").alias("cost_usd"))


O["cost_estimate"] = fx.with_views("""
SELECT ok, round(ok * 1500 * 0.08 / 1e6 + ok * 150 * 0.30 / 1e6, 4) AS cost_usd
FROM (SELECT count(*) FILTER (WHERE status = 'ok') AS ok FROM st)""", "v_payload", ctes=_PAY)


def grand_total(spark: SparkSession, sf: str) -> DataFrame:
    """Successes per source and overall (source null) over the described items."""
    d = _described(spark, sf).join(fx.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return rp.grand_total(d)


O["grand_total"] = fx.with_views("""
SELECT d.source, count(*) FILTER (WHERE st.status = 'ok') AS succeeded
FROM st JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.source)""", "v_payload", ctes=_PAY)


def mark_described(spark: SparkSession, sf: str) -> DataFrame:
    """Items flagged described when their describe run succeeded; others keep the flag."""
    ok = _described(spark, sf).where("status = 'ok'").join(fx.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        "source", F.concat(F.lit("item_"), F.col("doc_id").cast("string")).alias("id"))
    return wl.mark_described(_items(spark, sf), ok).select("source", "item_no", "id", "described")


O["mark_described"] = fx.with_views("""
SELECT source, item_no, id,
       CASE WHEN id IN (SELECT concat('item_', CAST(doc_id AS STRING)) FROM st WHERE status = 'ok') THEN true ELSE described END AS described
FROM v_manifest_items""", "v_payload", "v_manifest_items", ctes=_PAY)


def pipeline_status(spark: SparkSession, sf: str) -> DataFrame:
    return rp.pipeline_status(_items(spark, sf))


O["pipeline_status"] = fx.with_views("""
SELECT source, count(*) AS total, count(*) FILTER (WHERE coalesce(downloaded, false)) AS downloaded,
       count(*) FILTER (WHERE coalesce(described, false)) AS described
FROM v_manifest_items GROUP BY source""", "v_manifest_items")

Q.update({
    "pending_captions": pending_captions, "first_n_per_source": first_n_per_source, "pending_items": pending_items,
    "payload_clean_parse": payload_clean_parse, "payload_merge": payload_merge, "describe_recorded": describe_recorded,
    "fetch_status": fetch_status, "run_summary": run_summary, "cost_estimate": cost_estimate, "grand_total": grand_total,
    "mark_described": mark_described, "pipeline_status": pipeline_status,
})


def done_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A4 (tolerant): distinct URLs already present in a description output; bad lines skipped."""
    from loopdex.sources.descriptions import done_keys

    return done_keys(fx.view(spark, sf, "v_description_json"), "url")


O["done_ids"] = fx.with_views("""
SELECT DISTINCT json_extract_string(j, '$.url') AS url
FROM (SELECT CASE WHEN json_valid(line) THEN line END AS j FROM v_description_json)
WHERE json_extract_string(j, '$.url') IS NOT NULL""", "v_description_json")


def needs_description(spark: SparkSession, sf: str) -> DataFrame:
    """Per item, whether it needs a description (and under force)."""
    it = _items(spark, sf)
    return it.select("source", "item_no", wl.needs_description(False).alias("needs"), wl.needs_description(True).alias("needs_forced"))


O["needs_description"] = fx.with_views(f"""
SELECT source, item_no, {_NEED} AS needs, coalesce(downloaded, false) AS needs_forced FROM v_manifest_items""",
    "v_manifest_items")

Q.update({"done_ids": done_ids, "needs_description": needs_description})
