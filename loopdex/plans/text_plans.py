"""Full-text plans over the documents corpus (benchmark passages as queries) and tag plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.config import SearchConfig
from loopdex.operators import inverted as ix
from loopdex.operators import search as S
from loopdex.operators import tag_bitmaps as tb
from loopdex.operators import text_index as ti
from loopdex.operators.util import round6
from loopdex.plans.common import BLOCKED, BM25_K, built
from loopdex.plans.oracle_search import search_ctes, tok
from loopdex.plans.search_plans import fixture_search, fixture_store
from loopdex.sources import fixtures as fx

Q: dict = {}
O: dict = {}
CFG = SearchConfig(limit=20, blocked_tags=BLOCKED)


def documents_index(spark, sf) -> ix.TextIndex:
    """The index of documents, as ingest leaves it."""
    path = built(spark, "documents-index", [f"{sf}/documents.parquet"], lambda path: ix.write_index(fx.table(spark, sf, "documents"), path))
    return ix.read_index(spark, path)


def _bench(spark, sf):
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("clause_id"), "text")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """From the lengths that the index holds."""
    return ti.corpus_stats(documents_index(spark, sf).docs).select("n_docs", round6("avgdl").alias("avgdl"))


_DOCS = f"d AS (SELECT doc_id, {tok('text')} AS toks, len({tok('text')}) AS dl FROM documents)"
O["corpus_stats"] = fx.with_views("SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM d", ctes=_DOCS)


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and collection frequency of every token."""
    return ix.token_stats(documents_index(spark, sf))


O["token_stats"] = fx.with_views("""
SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(toks) AS token FROM d) GROUP BY token""", ctes=_DOCS)


def match_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage (whole text) as an OR query; top 10 documents each, by block maxima."""
    top = ix.match_top(documents_index(spark, sf), _bench(spark, sf), BM25_K)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", round6("score").alias("score"))


_BM = f"""{_DOCS},
st AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM d),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM d) GROUP BY ALL),
dfs AS (SELECT token, count(*)::DOUBLE AS df FROM post GROUP BY token),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct({tok('text')})) AS token FROM benchmark),
sc AS (
  SELECT qt.query_id, p.doc_id,
         sum(ln(1 + (st.n - f.df + 0.5) / (f.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * d.dl / st.avgdl))) AS score
  FROM qt JOIN post p USING (token) JOIN dfs f USING (token) JOIN d USING (doc_id) CROSS JOIN st GROUP BY ALL)"""
O["match_bm25"] = fx.with_views(f"""
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) WHERE rank <= {BM25_K}""",
    ctes=_BM)


def match_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """I4: every benchmark passage (whole text) as a phrase; all occurrences counted, from the position lists."""
    index = documents_index(spark, sf)
    p = ix.phrase_hits(index, _bench(spark, sf)).join(index.docs.select("range", "local", "doc_id"), ["range", "local"])
    return p.select("query_id", "doc_id", "tf", round6("score").alias("score"))


O["match_phrase"] = fx.with_views("""
SELECT query_id, doc_id, tf, round(idf_sum * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / st.avgdl)), 6) AS score
FROM (
  SELECT a.query_id, d.doc_id, d.dl, count(*) AS tf
  FROM anchor a JOIN posts p ON p.token = a.token AND p.pos >= a.place JOIN d ON d.doc_id = p.doc_id
  WHERE list_slice(d.toks, p.pos - a.place + 1, p.pos - a.place + len(a.ptoks)) = a.ptoks
  GROUP BY a.query_id, d.doc_id, d.dl) t
JOIN ph_idf USING (query_id) CROSS JOIN st WHERE tf > 0""",
    ctes=_BM + f""",
posts AS (SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM d),
ph AS (SELECT item_id AS query_id, {tok('text')} AS ptoks FROM benchmark),
anchor AS (
  SELECT query_id, ptoks, token, place FROM (SELECT query_id, ptoks, unnest(ptoks) AS token, unnest(range(1, len(ptoks) + 1)) AS place FROM ph)
  LEFT JOIN dfs USING (token) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(df, 0), place) = 1),
ph_idf AS (
  SELECT query_id, sum(ln(1 + (st.n - coalesce(f.df, 0) + 0.5) / (coalesce(f.df, 0) + 0.5))) AS idf_sum
  FROM (SELECT DISTINCT query_id, unnest(list_distinct(ptoks)) AS token FROM ph) t LEFT JOIN dfs f USING (token) CROSS JOIN st
  GROUP BY query_id)""")


# ---------------------------------------------------------------- fixture corpus (v_docs + v_queries)

def conjuncts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents matching every text clause (phrases AND loose match), summed score,
    with tag filters and exclusions applied."""
    tc = fixture_search(spark, sf, CFG).text_candidates()
    return tc.select(F.col("query_id").cast("long").alias("query_id"), "doc_id", round6("tscore").alias("tscore"))


def _fixture(spark, sf):
    fx.register(spark, sf, ("v_docs", "v_queries"))
    return S.prepare_queries(spark.table("v_queries")), fixture_store(spark, sf, CFG)


def _documents(store, rows, *columns):
    """The documents of rows (.., range, local)."""
    return rows.join(store.text.docs.select("range", "local", "doc_id", *columns), ["range", "local"])


_SEARCH = search_ctes(limit=20, depth=20, blocked=BLOCKED)
O["conjuncts"] = fx.with_views("SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(tscore, 6) AS tscore FROM tcand",
                               "v_docs", "v_queries", ctes=_SEARCH)


def tag_browse(spark: SparkSession, sf: str) -> DataFrame:
    """I16: tag-only queries: every document passing the tag clauses and exclusions."""
    pq, store = _fixture(spark, sf)
    m = S.query_masks(pq.where("mode = 'tags'"), store, CFG)
    found = _documents(store, tb.places(m.bits), "seq").join(m.of, "filter")
    return found.select(F.col("query_id").cast("long").alias("query_id"), "doc_id", "seq")


O["tag_browse"] = fx.with_views("SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, seq FROM tagcand", "v_docs", "v_queries",
                                ctes=_SEARCH)


def tag_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """(query, doc) pairs removed by a query's own -tag: clauses."""
    pq, store = _fixture(spark, sf)
    clauses = pq.select(F.col("query_id").cast("long").alias("query_id"), F.explode("neg").alias("clause"))
    hit = tb.places(tb.clause_bitmaps(store.tags, clauses), "bits")
    return _documents(store, hit).select("query_id", "doc_id")


O["tag_exclude"] = fx.with_views("""
SELECT DISTINCT CAST(q.query_id AS BIGINT) AS query_id, d.doc_id FROM q JOIN d ON TRUE
WHERE len(list_filter(q.neg, lambda c: len(c) > 0 AND len(list_filter(d.tag_toks, lambda tt_: contains(' ' || array_to_string(tt_, ' ') || ' ', ' ' || array_to_string(c, ' ') || ' '))) > 0)) > 0""",
    "v_docs", "v_queries", ctes=_SEARCH)


def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    """(query, doc) pairs passing every positive tag clause (term or phrase)."""
    pq, store = _fixture(spark, sf)
    asked, of = tb.filters(pq.where(F.size("req") > 0), neg=None)
    hit = _documents(store, tb.places(tb.masks(store.tags, asked))).join(of, "filter")
    return hit.select(F.col("query_id").cast("long").alias("query_id"), "doc_id")


O["tag_filter"] = fx.with_views("""
SELECT DISTINCT CAST(q.query_id AS BIGINT) AS query_id, d.doc_id FROM q JOIN d ON len(q.req) > 0
WHERE len(list_filter(q.req, lambda c: NOT (len(c) > 0 AND len(list_filter(d.tag_toks, lambda tt_: contains(' ' || array_to_string(tt_, ' ') || ' ', ' ' || array_to_string(c, ' ') || ' '))) > 0))) = 0""",
    "v_docs", "v_queries", ctes=_SEARCH)

Q.update({
    "corpus_stats": corpus_stats, "token_stats": token_stats, "match_bm25": match_bm25, "match_phrase": match_phrase,
    "conjuncts": conjuncts, "tag_browse": tag_browse, "tag_exclude": tag_exclude, "tag_filter": tag_filter,
})
