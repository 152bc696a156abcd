"""DuckDB oracle SQL for the search plans (independent brute-force formulation)."""

from __future__ import annotations

from loopdex.sources.fixtures import with_views

TOK = "regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"


def tok(x: str) -> str:
    return TOK.format(x=x)


def _contains(tt: str, clause: str) -> str:
    return (f"(len({clause}) > 0 AND len(list_filter({tt}, lambda tt_: contains(' ' || array_to_string(tt_, ' ') || ' ', "
            f"' ' || array_to_string({clause}, ' ') || ' '))) > 0)")


PARSE = """
p1 AS (SELECT query_id, vec_id, coalesce(raw, '') AS r0 FROM v_queries),
p2 AS (SELECT *, regexp_extract_all(r0, '-tag:"([^"]+)"', 1) AS neg_q, regexp_replace(r0, '-tag:"([^"]+)"', '', 'g') AS r1 FROM p1),
p3 AS (SELECT *, regexp_extract_all(r1, '-tag:(\\S+)', 1) AS neg_b, regexp_replace(r1, '-tag:(\\S+)', '', 'g') AS r2 FROM p2),
p4 AS (SELECT *, regexp_extract_all(r2, 'tag:"([^"]+)"', 1) AS tag_q, regexp_replace(r2, 'tag:"([^"]+)"', '', 'g') AS r3 FROM p3),
p5 AS (SELECT *, regexp_extract_all(r3, 'tag:(\\S+)', 1) AS tag_b, regexp_replace(r3, 'tag:(\\S+)', '', 'g') AS r4 FROM p4),
p6 AS (SELECT *, regexp_extract_all(r4, '"([^"]+)"', 1) AS phr, regexp_replace(r4, '"([^"]+)"', '', 'g') AS r5 FROM p5),
pq AS (
  SELECT query_id, vec_id,
         list_transform(phr, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS phrases,
         regexp_replace(r5, '^\\s+|\\s+$', '', 'g') AS loose,
         list_transform(list_concat(tag_q, tag_b), lambda x: lower(x)) AS tags,
         list_transform(list_concat(neg_q, neg_b), lambda x: lower(x)) AS neg_tags
  FROM p6)
"""


def parse_sql(view: str = "v_queries") -> str:
    return PARSE.replace("FROM v_queries", f"FROM {view}")


#: Documents and queries by their given vectors.
GIVEN = """
vdocs AS (SELECT d.doc_id, e.embedding::DOUBLE[] AS emb FROM embeddings e JOIN v_docs d ON e.vec_id = d.seq),
vpair AS (
  SELECT q.query_id, v.doc_id, list_dot_product(qe.embedding::DOUBLE[], v.emb) AS vscore
  FROM q JOIN embeddings qe ON qe.vec_id = q.vec_id CROSS JOIN vdocs v WHERE q.mode = 'hybrid'),"""


def hashed(name: str, rows: str, key: str, text: str) -> str:
    """CTE name (key, bucket, w): hash embeddings of rows' text, components that aren't zero."""
    return f"""
{name}_c AS (
  SELECT {key}, CAST(CAST(concat('0x', substr(md5(token), 1, 8)) AS UBIGINT) % 384 AS INTEGER) AS bucket, count(*)::DOUBLE AS c
  FROM (SELECT {key}, unnest({tok(text)}) AS token FROM {rows}) GROUP BY ALL),
{name} AS (
  SELECT {key}, bucket, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w FROM {name}_c)"""


#: Documents and queries by the embedder.
EMBEDDED = hashed("de", "v_docs", "doc_id", "combined_text").lstrip() + "," + hashed("qe", "q", "query_id", "loose") + """,
vpair AS (
  SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0) AS vscore
  FROM q CROSS JOIN d LEFT JOIN (
    SELECT query_id, doc_id, sum(qe.w * de.w) AS score FROM qe JOIN de USING (bucket) GROUP BY ALL) s
    ON s.query_id = q.query_id AND s.doc_id = d.doc_id
  WHERE q.mode = 'hybrid'),"""


def search_ctes(limit: int = 20, depth: int = 20, blocked=("nsfw",), k1=1.2, b=0.75, rrf_k=60, embedded: bool = False) -> str:
    blocked_list = "[" + ", ".join(tok(f"'{t}'") for t in blocked) + "]"
    req_ok = f"(len(list_filter(q.req, lambda c: NOT {_contains('d.tag_toks', 'c')})) = 0)"
    neg_hit = f"(len(list_filter(q.neg, lambda c: {_contains('d.tag_toks', 'c')})) > 0)"
    return PARSE + f""",
q AS (
  SELECT query_id, vec_id, phrases, loose, tags, neg_tags,
         list_transform(tags, lambda t: CASE WHEN contains(t, ' ') THEN {tok('t')} ELSE [t] END) AS req,
         list_transform(neg_tags, lambda t: {tok('t')}) AS neg,
         CASE WHEN loose <> '' THEN 'hybrid' WHEN len(phrases) > 0 THEN 'text' WHEN len(tags) > 0 THEN 'tags' ELSE 'all' END AS mode
  FROM pq),
d0 AS (
  SELECT doc_id, seq, combined_text AS text,
         coalesce(list_transform(tags, lambda t: {tok('t')}), []) AS tag_toks
  FROM v_docs),
d AS (
  SELECT *, len(list_filter({blocked_list}, lambda c: {_contains('tag_toks', 'c')})) > 0 AS excluded,
         {tok('text')} AS toks, len({tok('text')}) AS dl
  FROM d0),
st AS (SELECT count(*)::DOUBLE AS n_docs, avg(dl)::DOUBLE AS avgdl FROM d),
clauses AS (
  SELECT query_id, i - 1 AS clause_id, 'phrase' AS kind, phrases[i] AS text
  FROM (SELECT query_id, phrases, unnest(range(1, len(phrases) + 1)) AS i FROM q WHERE mode IN ('hybrid', 'text'))
  UNION ALL
  SELECT query_id, len(phrases) AS clause_id, 'match' AS kind, loose AS text FROM q WHERE loose <> ''),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM d) GROUP BY doc_id, token),
dfs AS (SELECT token, count(*)::DOUBLE AS df FROM post GROUP BY token),
mterms AS (SELECT DISTINCT query_id, clause_id, unnest(list_distinct({tok('text')})) AS token FROM clauses WHERE kind = 'match'),
mscore AS (
  SELECT m.query_id, m.clause_id, p.doc_id,
         sum(ln(1 + (st.n_docs - f.df + 0.5) / (f.df + 0.5)) * (p.tf * ({k1} + 1)) / (p.tf + {k1} * (1 - {b} + {b} * d.dl / st.avgdl))) AS score
  FROM mterms m JOIN post p ON p.token = m.token JOIN dfs f ON f.token = m.token JOIN d ON d.doc_id = p.doc_id CROSS JOIN st
  GROUP BY m.query_id, m.clause_id, p.doc_id),
ph AS (SELECT query_id, clause_id, {tok('text')} AS ptoks FROM clauses WHERE kind = 'phrase'),
ph_idf AS (
  SELECT query_id, clause_id, sum(ln(1 + (st.n_docs - coalesce(f.df, 0) + 0.5) / (coalesce(f.df, 0) + 0.5))) AS idf_sum
  FROM (SELECT DISTINCT query_id, clause_id, unnest(list_distinct(ptoks)) AS token FROM ph) t
       LEFT JOIN dfs f ON f.token = t.token CROSS JOIN st
  GROUP BY query_id, clause_id),
ph_tf AS (
  SELECT ph.query_id, ph.clause_id, d.doc_id, d.dl,
         len(list_filter(range(1, d.dl - len(ph.ptoks) + 2), lambda i: list_slice(d.toks, i, i + len(ph.ptoks) - 1) = ph.ptoks)) AS tf
  FROM ph JOIN d ON len(ph.ptoks) > 0 AND d.dl >= len(ph.ptoks)),
pscore AS (
  SELECT t.query_id, t.clause_id, t.doc_id,
         i.idf_sum * (t.tf * ({k1} + 1)) / (t.tf + {k1} * (1 - {b} + {b} * t.dl / st.avgdl)) AS score
  FROM ph_tf t JOIN ph_idf i USING (query_id, clause_id) CROSS JOIN st WHERE t.tf > 0),
tc AS (
  SELECT c.query_id, c.doc_id, sum(c.score) AS tscore, count(*) AS n_hit
  FROM (SELECT * FROM mscore UNION ALL SELECT * FROM pscore) c GROUP BY c.query_id, c.doc_id),
tcand AS (
  SELECT tc.query_id, tc.doc_id, tc.tscore
  FROM tc JOIN q ON q.query_id = tc.query_id JOIN d ON d.doc_id = tc.doc_id
  WHERE tc.n_hit = len(q.phrases) + CASE WHEN q.loose <> '' THEN 1 ELSE 0 END
    AND NOT d.excluded AND {req_ok} AND NOT {neg_hit}),
tlist AS (
  SELECT query_id, doc_id, tscore, row_number() OVER (PARTITION BY query_id ORDER BY round(tscore, 6) DESC, doc_id) AS rnk FROM tcand
  QUALIFY rnk <= {depth}),
{(EMBEDDED if embedded else GIVEN).strip()}
vcand AS (
  SELECT p.query_id, p.doc_id, p.vscore
  FROM vpair p JOIN q ON q.query_id = p.query_id JOIN d ON d.doc_id = p.doc_id
  WHERE NOT d.excluded AND {req_ok} AND NOT {neg_hit}),
vlist AS (
  SELECT query_id, doc_id, vscore, row_number() OVER (PARTITION BY query_id ORDER BY round(vscore, 6) DESC, doc_id) AS rnk FROM vcand
  QUALIFY rnk <= {depth}),
fused AS (
  SELECT l.query_id, l.doc_id, sum(1.0 / ({rrf_k} + l.rnk)) AS fused, max(l.tscore) AS tscore, max(l.vscore) AS vscore
  FROM (SELECT query_id, doc_id, rnk, tscore, NULL::DOUBLE AS vscore FROM tlist
        UNION ALL SELECT query_id, doc_id, rnk, NULL::DOUBLE, vscore FROM vlist) l
  GROUP BY l.query_id, l.doc_id),
ranked_text AS (
  SELECT f.query_id, f.doc_id, CASE WHEN q.mode = 'hybrid' THEN f.fused ELSE f.tscore END AS list_score,
         CASE WHEN q.mode = 'hybrid' THEN f.vscore END AS vec_score, 0::BIGINT AS tie_seq
  FROM fused f JOIN q USING (query_id)),
tagcand AS (
  SELECT q.query_id, d.doc_id, d.seq FROM q JOIN d ON TRUE
  WHERE q.mode = 'tags' AND NOT d.excluded AND {req_ok} AND NOT {neg_hit}),
allcand AS (
  SELECT q.query_id, d.doc_id, d.seq FROM q JOIN d ON TRUE
  WHERE q.mode = 'all' AND NOT d.excluded AND NOT {neg_hit}),
cand AS (
  SELECT * FROM ranked_text
  UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE, NULL::DOUBLE, seq::BIGINT FROM tagcand
  UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE, NULL::DOUBLE, seq::BIGINT FROM allcand),
top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(list_score, 6) DESC, tie_seq, doc_id) AS pre_rank FROM cand
  QUALIFY pre_rank <= {limit}),
kept AS (
  SELECT t.*, v.original_description, v.combined_text
  FROM top t JOIN v_docs v ON v.doc_id = t.doc_id
  WHERE NOT (coalesce(contains(lower(v.literal), 'content has been removed'), false)
             OR coalesce(contains(lower(v.combined_text), 'content has been removed'), false))
    AND NOT coalesce(len(list_filter(v.tags, lambda x: lower(x) IN ({", ".join(f"'{t.lower()}'" for t in blocked)}))) > 0, false)),
hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pre_rank) AS rank, doc_id,
         coalesce(vec_score, list_score, 0.0) AS score, list_score,
         coalesce(original_description, combined_text, '') AS description
  FROM kept),
totals AS (
  SELECT q.query_id, coalesce(t.total, 0) AS total FROM q LEFT JOIN (
    SELECT query_id, count(DISTINCT doc_id) AS total FROM (
      SELECT query_id, doc_id FROM tcand UNION ALL SELECT query_id, doc_id FROM vlist
      UNION ALL SELECT query_id, doc_id FROM tagcand UNION ALL SELECT query_id, doc_id FROM allcand) GROUP BY query_id) t
  USING (query_id))
"""


def hybrid_search_sql() -> str:
    body = search_ctes()
    return with_views("""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score,
       round(list_score, 6) AS list_score, description
FROM hits""", "v_docs", "v_queries", ctes=body)


def search_totals_sql() -> str:
    return with_views("""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(total AS BIGINT) AS total FROM totals""", "v_docs", "v_queries", ctes=search_ctes())
