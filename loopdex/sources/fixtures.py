"""Derived fixture views over the driver tables.

Each view is one SQL text accepted unchanged by Spark SQL and DuckDB, so the Spark
query and its oracle read identical inputs. The views only reshape driver tables
(every row of the base table is used; the modulo tests inject edge cases).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["v_caption_lines"] = """
SELECT doc_id AS line_no,
       CASE WHEN doc_id % 17 = 3 THEN 'malformed line'
            ELSE concat('http://', CASE doc_id % 5 WHEN 0 THEN '38' WHEN 1 THEN '33' WHEN 2 THEN '31' WHEN 3 THEN '64' ELSE 'x' END,
                        '.media.tumblr.com/', substr(md5(lang), 1, 8),
                        CASE WHEN doc_id % 11 = 5 THEN '/noid_' ELSE '/tumblr_' END, substr(md5(text), 1, 12), '.gif', chr(9),
                        CASE WHEN doc_id % 13 = 4 THEN '' ELSE replace(text, chr(10), ' ') END) END AS line
FROM documents
"""

VIEWS["v_description_json"] = """
SELECT p_partkey AS line_no,
       CASE WHEN p_partkey % 101 = 7 THEN '{broken'
            ELSE concat('{', CASE WHEN p_partkey % 3 = 0 THEN concat('"id":"item_', CAST(p_partkey AS STRING), '",') ELSE '' END,
                        '"url":"http://64.media.tumblr.com/tumblr_', substr(md5(p_name), 1, 6), CAST(p_partkey % 1500 AS STRING), '.gif",',
                        CASE WHEN p_partkey % 4 = 1 THEN concat('"attribution":"http://example.com/', lower(p_type), '",') ELSE '' END,
                        '"original_description":"', p_name, '",',
                        '"literal":"', CASE WHEN p_partkey % 97 = 5 THEN 'This Content Has Been Removed' ELSE concat('A ', p_name, ' in motion') END, '",',
                        CASE WHEN p_partkey % 10 = 9 THEN '' ELSE concat('"source":"', p_brand, '",') END,
                        '"mood":', CASE WHEN p_partkey % 89 = 8 THEN '["odd"]' ELSE concat('"', lower(p_type), '"') END, ',',
                        CASE p_partkey % 6 WHEN 0 THEN '"action":"spinning",' WHEN 1 THEN '"action":["falling","rolling"],'
                                           WHEN 2 THEN '"action":null,' WHEN 3 THEN '"action":3,' WHEN 4 THEN '"action":[],' ELSE '' END,
                        '"context":"', lower(p_brand), ' reaction",',
                        '"tags":[', CASE WHEN p_partkey % 83 = 6 THEN '"a",1' ELSE concat('"', replace(p_name, ' ', '","'), '","', p_type, ' part"') END, ']}') END AS line
FROM part
"""

VIEWS["v_docs"] = """
SELECT concat('gif_', substr(md5(CAST(p_partkey AS STRING)), 1, 16)) AS doc_id, p_partkey AS seq,
       concat('http://64.media.tumblr.com/tumblr_', CAST(p_partkey AS STRING), '.gif') AS gif_url,
       CASE WHEN p_partkey % 2 = 0 THEN p_name END AS original_description,
       CASE WHEN p_partkey % 97 = 5 THEN 'This Content Has Been Removed' ELSE concat('A ', p_name, ' in motion') END AS literal,
       p_brand AS source, lower(p_type) AS mood,
       CASE WHEN p_partkey % 41 = 1 THEN NULL
            ELSE split(concat(replace(p_name, ' ', ';'), ';', p_type, ' Part', CASE WHEN p_partkey % 53 = 2 THEN ';NSFW' ELSE '' END), ';') END AS tags,
       concat(CASE WHEN p_partkey % 97 = 5 THEN 'This Content Has Been Removed' ELSE concat('A ', p_name, ' in motion') END,
              '. Source: ', p_brand, '. Mood: ', lower(p_type), '. Actions: . Use case: . Tags: ', replace(p_name, ' ', ', ')) AS combined_text
FROM part
"""

VIEWS["v_queries"] = """
SELECT * FROM (VALUES
  (1, 'red widget', 3), (2, '"small ring"', 5), (3, 'tag:blue', 7), (4, 'bolt tag:"SMALL Part"', 11), (5, 'gear -tag:hot', 13),
  (6, '-tag:"PROMO Part" -tag:old', 17), (7, '"red bolt" anvil tag:red tag:"LARGE Part"', 19), (8, 'hashtag:foo ring', 23),
  (9, 'tag:"open plate', 29), (10, '', 31), (11, '   ', 37), (12, 'zzznothing', 41), (13, 'the and of', 43)) AS q(query_id, raw, vec_id)
"""

# Every part and every benchmark passage as a query: each form of the syntax, alone, mixed, empty or left open.
VIEWS["v_query_texts"] = """
SELECT p_partkey AS query_id, p_partkey AS vec_id,
       CASE p_partkey % 20
         WHEN 0 THEN p_name
         WHEN 1 THEN concat('"', p_name, '"')
         WHEN 2 THEN concat('tag:', split_part(p_name, ' ', 1))
         WHEN 3 THEN concat('tag:"', p_type, ' Part"')
         WHEN 4 THEN concat('-tag:', lower(p_type))
         WHEN 5 THEN concat('-tag:"', p_type, ' Part" ', p_name)
         WHEN 6 THEN concat(p_name, ' tag:', split_part(p_name, ' ', 2), ' -tag:"', p_type, '"')
         WHEN 7 THEN concat('"', p_name, '" "', p_brand, '" ', lower(p_type), ' tag:', p_type)
         WHEN 8 THEN concat('tag:"', p_name)
         WHEN 9 THEN concat('"', p_name, ' ', p_brand)
         WHEN 10 THEN concat('hash', 'tag:', p_brand, ' ', p_name)
         WHEN 11 THEN concat('tag:"! !" ', p_brand)
         WHEN 12 THEN concat('  ', p_name, chr(9), chr(10))
         WHEN 13 THEN ''
         WHEN 14 THEN '   '
         WHEN 15 THEN concat('"   " tag: -tag: ', p_type)
         WHEN 16 THEN concat('"" tag:""', p_name)
         WHEN 17 THEN concat('-', 'tag:"', p_brand, '"', 'tag:', p_type, ' tag:"', p_name, '"')
         WHEN 18 THEN concat('TAG:', p_brand, ' -Tag:"', p_type, '"')
       END AS raw
FROM part
UNION ALL
SELECT -1 - 2 * item_id AS query_id, item_id AS vec_id, text AS raw FROM benchmark
UNION ALL
SELECT -2 - 2 * item_id AS query_id, item_id AS vec_id, concat('"', text, '" tag:', CAST(item_id AS STRING)) AS raw FROM benchmark
"""

VIEWS["v_updates"] = """
SELECT concat('gif_', CAST(c_custkey % 100 AS STRING)) AS doc_id, c_custkey AS seq, c_mktsegment AS value FROM customer
"""

VIEWS["v_manifest_items"] = """
SELECT d.source, d.doc_id AS item_no, concat('item_', CAST(d.doc_id AS STRING)) AS id,
       concat('http://example.com/', CAST(d.doc_id AS STRING), '.gif') AS original_url,
       CASE WHEN d.doc_id % 3 = 0 THEN concat('http://example.com/p/', CAST(d.doc_id AS STRING)) END AS page_url,
       CASE d.doc_id % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webm' WHEN 2 THEN 'gif' END AS format,
       CASE WHEN d.doc_id % 10 < 8 THEN TRUE WHEN d.doc_id % 10 = 8 THEN FALSE END AS downloaded,
       CASE WHEN l.quality = 1 THEN TRUE WHEN l.quality = 0 THEN FALSE END AS described
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["v_payload"] = """
SELECT doc_id, concat('http://example.com/', CAST(doc_id AS STRING), '.gif') AS url, lang AS original_description,
       CASE WHEN doc_id % 19 = 2 THEN 'timeout' END AS fetch_error,
       CASE WHEN doc_id % 23 = 4 THEN 'https://assets.tumblr.com/images/media_violation/x.png' ELSE concat('http://example.com/', CAST(doc_id AS STRING), '.gif') END AS final_url,
       CASE doc_id % 8
         WHEN 0 THEN concat('```json', chr(10), '{"literal":"', source, '","tags":["', lang, '"]}', chr(10), '```')
         WHEN 1 THEN concat('  {"literal":"', source, '","action":"jump"}  ')
         WHEN 2 THEN concat('```json', chr(10), '{"literal":"', source, '"}')
         WHEN 3 THEN '{}' WHEN 4 THEN 'not json' WHEN 5 THEN '[1,2]'
         WHEN 6 THEN concat('{"literal":"', source, '","url":"http://override/', CAST(doc_id AS STRING), '"}')
         ELSE '```{"literal":"one line"}```' END AS payload
FROM documents
"""

VIEWS["v_media"] = """
SELECT p_partkey AS media_id, p_size AS n_frames, CAST(100 + p_partkey % 1900 AS INT) AS w, CAST(80 + (p_partkey * 7) % 1100 AS INT) AS h,
       CASE p_partkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webm' WHEN 2 THEN 'gif' END AS format,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) / 4 WHEN p_partkey % 3 = 1 THEN CAST(0 AS DOUBLE) END AS duration,
       CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 3 END AS nb_frames,
       CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 30 END AS rate_num, 1 AS rate_den
FROM part
"""

# Payloads with keys that no schema lists: nested objects, numbers, flags, nulls, empty strings and timestamps.
VIEWS["v_open_payload"] = """
SELECT doc_id, concat('item_', CAST(doc_id AS STRING)) AS id, concat('http://example.com/', CAST(doc_id AS STRING), '.gif') AS url,
       CASE WHEN doc_id % 3 = 0 THEN concat('http://example.com/p/', CAST(doc_id AS STRING)) END AS page_url,
       CASE WHEN doc_id % 4 = 1 THEN lang END AS title,
       concat('{"literal":"', source, '"',
              CASE WHEN doc_id % 2 = 0 THEN concat(',"nested":{"a":', CAST(doc_id AS STRING), ',"b":["x",{"c":null}]}') ELSE '' END,
              CASE WHEN doc_id % 5 = 1 THEN ',"rating":3,"seen_by_all":true' WHEN doc_id % 5 = 2 THEN ',"rating":null,"mood":""' ELSE '' END,
              CASE WHEN doc_id % 7 = 3 THEN ',"tags":["red",1,null,"blue"]' WHEN doc_id % 7 = 4 THEN ',"tags":[]' ELSE '' END,
              CASE WHEN doc_id % 6 = 0 THEN ',"created_at":"2024-01-02T03:04:05Z"' WHEN doc_id % 6 = 1 THEN ',"created_at":"2024-01-02","timestamp":"2025"' ELSE '' END,
              CASE WHEN doc_id % 9 = 2 THEN concat(',"url":"http://other/', CAST(doc_id AS STRING), '","video_URL":"v"') ELSE '' END,
              CASE WHEN doc_id % 4 = 2 THEN ',"description":"shown"' WHEN doc_id % 8 = 1 THEN ',"description":"hidden"' ELSE '' END,
              '}') AS payload
FROM documents
"""


# Base tables each view reads (so a plan registers only what it scans).
VIEW_DEPS = {
    "v_caption_lines": ("documents",), "v_description_json": ("part",), "v_docs": ("part",), "v_queries": (),
    "v_query_texts": ("part", "benchmark"),
    "v_updates": ("customer",), "v_manifest_items": ("documents", "labels"), "v_payload": ("documents",),
    "v_media": ("part",), "v_open_payload": ("documents",),
}
_REGISTERED: dict = {}


def _register_one(spark: SparkSession, name: str, sf_dir: str, make) -> None:
    key = (id(spark), name)
    if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists(name):
        return
    make().createOrReplaceTempView(name)
    _REGISTERED[key] = sf_dir


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> None:
    """Register the driver tables the named views need (all when None), then the views.

    Registration is skipped when the same data directory is already registered in this
    session, so repeated plans do not re-list files or re-read footers.
    """
    views = tuple(VIEWS) if names is None else tuple(n for n in names if n in VIEWS)
    bases = set(BASE_TABLES) if names is None else {t for v in views for t in VIEW_DEPS[v]} | \
        {n for n in names if n in BASE_TABLES}
    if names is not None and any(n in ("v_docs", "v_queries") for n in names):
        bases.add("embeddings")
    for t in sorted(bases):
        _register_one(spark, t, sf_dir, lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    for v in views:
        _register_one(spark, v, sf_dir, lambda v=v: spark.sql(VIEWS[v]))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir, (name,))
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str, ctes: str = "") -> str:
    """Oracle SQL with the named views (and extra CTE text) inlined (DuckDB side)."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    if ctes.strip():
        parts.append(ctes.strip())
    return f"WITH {', '.join(parts)}\n{sql}" if parts else sql
